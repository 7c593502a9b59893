"""Default question profiles: known headers and how their answers are analysed.

Profiles are a parameter of matching; pass another list for another questionnaire.
Patterns are written in header-key form (NFKC, lower case, no spaces or symbols). The label's
own header key is always a pattern too, so it is not repeated among the patterns.
"""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(frozen=True)
class Profile:
    key: str
    label: str
    kind: str
    chart: str
    order: str
    patterns: tuple[str, ...] = ()
    presets: tuple[str, ...] = ()
    aliases: dict[str, str] = field(default_factory=dict)
    unit: str | None = None
    delimiters: tuple[str, ...] = ()
    identity: str | None = None


# ---- fixed values: spellings of AI tools and of gender answers ----------------------------
AI_TOOLS = {
    "chatgpt": "ChatGPT",
    "chat gpt": "ChatGPT",
    "チャットgpt": "ChatGPT",
    "チャット gpt": "ChatGPT",
    "claude": "Claude",
    "claude ai": "Claude",
    "クロード": "Claude",
    "gemini": "Gemini",
    "google gemini": "Gemini",
    "ジェミニ": "Gemini",
    "github copilot": "GitHub Copilot",
    "microsoft copilot": "Microsoft Copilot",
    "perplexity": "Perplexity",
    "midjourney": "Midjourney",
    "stable diffusion": "Stable Diffusion",
    "notebooklm": "NotebookLM",
    "felo": "Felo",
    "canva ai": "Canva AI",
}
GENDERS = {
    "male": "男性",
    "female": "女性",
    "man": "男性",
    "woman": "女性",
    "男": "男性",
    "女": "女性",
    "答えたくない": "回答しない",
    "回答したくない": "回答しない",
    "無回答": "回答しない",
    "未回答": "回答しない",
}

# ---- fixed values: the questionnaire ------------------------------------------------------
DEFAULT_PROFILES: tuple[Profile, ...] = (
    Profile(
        "age", "年齢", "single", "bar", "preset",
        ("あなたの年齢", "ご年齢", "年齢を教え", "年齢層", "年代", "おいくつ"),
        presets=("18～24", "25～34", "35～44", "45～54", "55～64", "65～74", "75以上"),
    ),
    Profile(
        "gender", "性別", "single", "pie", "preset",
        ("あなたの性別", "ご性別", "性別を教え", "性自認", "gender"),
        presets=("女性", "男性", "その他", "回答しない"),
        aliases=GENDERS,
    ),
    Profile(
        "occupation", "現在の職種", "single", "hbar", "count",
        ("職種を教え", "ご職種", "本業の職種", "どんな職種", "職種", "職業"),
    ),
    Profile(
        "channel", "仕事を受注したサービス・経路", "multiple", "hbar", "count",
        ("受注したサービス", "受注したプラットフォーム", "仕事を受けたサービス", "どこで仕事を受注",
         "クラウドソーシング", "案件の獲得経路", "サービス経路", "受注経路"),
    ),
    Profile(
        "start-year", "仕事を受注・開始した年", "single", "bar", "natural",
        ("受注開始した年", "仕事を始めた年", "受注した年", "開始した年", "着手した年", "受注年", "開始年", "西暦"),
    ),
    Profile(
        "start-month", "仕事を受注・開始した月", "single", "bar", "preset",
        ("受注開始した月", "仕事を始めた月", "受注した月", "開始した月", "着手した月", "受注月", "開始月", "何月"),
        presets=("1月", "2月", "3月", "4月", "5月", "6月", "7月", "8月", "9月", "10月", "11月", "12月"),
    ),
    Profile(
        "job-category", "仕事の主なカテゴリ", "single", "hbar", "count",
        ("仕事のカテゴリ", "案件のカテゴリ", "主なカテゴリ", "業務カテゴリ", "仕事のジャンル",
         "仕事の種類", "案件の種類", "カテゴリ"),
    ),
    Profile(
        "job-detail", "具体的に行った仕事内容", "free", "none", "count",
        ("具体的に行った仕事", "具体的な仕事内容", "どのような仕事をした", "実際に行った作業",
         "仕事内容", "業務内容", "作業内容", "案件内容"),
    ),
    Profile(
        "contract-type", "契約・報酬形式", "single", "hbar", "count",
        ("固定報酬か時間単価", "契約報酬の形式", "報酬形式", "報酬の形態", "契約形式", "契約形態",
         "契約の種類", "支払い形式"),
    ),
    Profile(
        "reward", "報酬", "single", "bar", "preset",
        ("受け取った報酬", "報酬はいくら", "報酬の総額", "報酬金額", "報酬額", "金額", "単価", "売上"),
        presets=("200円未満", "200～499円", "500～999円", "1,000～2,999円", "3,000～4,999円",
                 "5,000～9,999円", "10,000～29,999円", "30,000～49,999円", "50,000～99,999円",
                 "100,000～149,999円"),
        unit="円",
    ),
    Profile(
        "work-hours", "実際の作業時間", "single", "bar", "preset",
        ("作業にかかった時間", "かかった時間", "作業時間", "稼働時間", "所要時間", "制作時間", "何時間"),
        presets=("〜1時間", "1〜3時間", "3〜5時間", "5〜10時間", "10〜20時間", "20時間以上"),
        unit="時間",
    ),
    Profile(
        "ai-tools", "使用したAI・AIツール", "multiple", "hbar", "count",
        ("使用aiツール", "生成aiツール", "aiサービス", "aiツール", "使用したai", "利用したai", "使ったai"),
        aliases=AI_TOOLS,
    ),
    Profile(
        "main-ai", "一番使ったAI", "single", "hbar", "count",
        ("一番使った生成ai", "最もよく使ったai", "一番よく使ったai", "メインで使ったai",
         "一番使用したai", "一番利用したai", "最も使ったai"),
        aliases=AI_TOOLS,
    ),
    Profile(
        "ai-usage", "AIを何に使ったか", "multiple", "hbar", "count",
        ("使用したaiの用途", "aiを使った業務", "どんな作業に使", "aiの活用場面", "aiの使い道",
         "aiの用途", "aiを何に", "何に使"),
    ),
    Profile(
        "ai-ratio", "AI利用割合", "single", "bar", "preset",
        ("aiをどのくらい使い", "aiツールの利用割合", "仕事全体のうち", "aiが占めた割合", "aiの利用割合",
         "ai利用の割合", "aiの割合", "割合"),
        presets=("ほとんど使っていない(1～20%程度)", "一部で使った(21～40%程度)",
                 "半分くらい使った(41～60%程度)", "大部分で使った(61～80%程度)",
                 "ほぼAIを使った(81～100%程度)"),
    ),
    Profile(
        "human-edit", "AI出力を人間がどれくらい修正したか", "single", "bar", "preset",
        ("aiが作ったものをどのくらい人間が修正", "aiが作ったものを", "ai出力をどれくらい修正",
         "aiの出力を修正", "ai出力の修正", "どれくらい修正", "修正の度合い", "人間が修正", "手直し"),
        presets=("ほぼ修正していない", "少し修正した", "かなり修正した", "ほぼ作り直した",
                 "何度も作り直した", "AIは完成物の作成には使っていない"),
    ),
    Profile(
        "without-ai", "AIがなければ仕事を受けたか", "single", "pie", "preset",
        ("aiを使わない場合", "aiなしでも受け", "aiがなかったら", "aiがなくても", "aiがない場合",
         "aiがなければ", "aiが無ければ", "aiなしでも"),
        presets=("受けていた", "たぶん受けていた", "たぶん受けていなかった", "受けていなかった", "わからない"),
    ),
    Profile(
        "client-ai-rule", "クライアント側のAI利用ルール", "single", "hbar", "preset",
        ("ai利用に関するルール", "ai利用についてのルール", "クライアント側のai", "ai利用のルール",
         "aiの利用ルール", "ai利用ルール", "ai利用の可否", "ai利用の条件", "ルール"),
        presets=("AI利用可と明記されていた", "条件付きでAI利用可だった", "AI利用禁止だった",
                 "AIについての記載はなかった"),
    ),
    Profile(
        "disclosed-ai", "AI利用をクライアントに伝えたか", "single", "pie", "preset",
        ("クライアントに伝え", "aiの利用を伝え", "ai利用を開示", "ai利用の開示", "ai利用を申告",
         "ai利用を伝え", "ai使用を伝え", "伝えましたか"),
        presets=("伝えた", "伝えていない", "AI利用を伝える必要がなかった", "わからない"),
    ),
    Profile(
        "revision-count", "修正回数", "single", "bar", "preset",
        ("修正を求められた回数", "修正依頼の回数", "リテイク数", "修正の回数", "修正は何回", "何回修正",
         "修正依頼"),
        presets=tuple(f"{n}回" for n in range(6)) + ("6回以上",),
        unit="回",
    ),
    Profile(
        "job-result", "仕事の結果", "single", "hbar", "preset",
        ("受注した仕事の結果", "クライアントの評価", "評価はどうだった", "結果はどうなった",
         "仕事の成否", "納品の結果", "案件の結果"),
        presets=("問題なく完了した", "修正後に完了した", "高評価だった", "修正が多かった",
                 "契約解除・不採用になった"),
    ),
    Profile(
        "repeat-intent", "また同じような仕事を受けたいか", "single", "hbar", "preset",
        ("似たような仕事があった場合", "また同じように受けたい", "同じような仕事を受けたい",
         "継続して受けたい", "今後の受注意向", "次も受けたい", "また同じ仕事", "また受けたい", "再度受けたい"),
        presets=("ぜひ受けたい", "条件次第で受けたい", "受けてもよい", "どちらとも言えない",
                 "あまり受けたくない", "受けたくない", "わからない"),
    ),
    Profile(
        "free-comment", "自由記述", "free", "none", "count",
        ("何かあればこちらへ", "その他ご意見", "最後に一言", "自由回答", "何かあれば", "ご自由に",
         "コメント", "ご意見", "感想"),
    ),
    Profile(
        "worker-name", "作業者名", "ignore", "none", "count",
        ("作業者", "ワーカー名", "応募者名", "会員名", "ユーザー名", "ニックネーム"),
        identity="worker-name",
    ),
    Profile(
        "worker-url", "作業者ページURL", "ignore", "none", "count",
        ("作業者ページ", "ワーカーページurl", "プロフィールurl", "ユーザーページurl", "会員ページurl"),
        identity="worker-url",
    ),
    Profile(
        "worker-id", "作業ID", "ignore", "none", "count",
        ("作業no", "タスクid", "ワークid", "応募id", "回答id"),
        identity="worker-id",
    ),
    Profile(
        "approved-at", "承認日時", "ignore", "none", "count",
        ("承認日", "検収日時", "検収日", "承認日付"),
        identity="approved-at",
    ),
)
