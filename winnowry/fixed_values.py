"""Fixed values.

Word lists, thresholds, formats and texts that decide results. They are inputs of the
operators (every one can be replaced by an argument) and are written out as plain text.
"""

# ---- Fixed values: tasks -------------------------------------------------------------

LOW_QUALITY = "is_low_quality"
AI_GENERATED = "is_ai_generated"

TASKS = [
    {
        "task_id": LOW_QUALITY,
        "ordinal": 1,
        "name": "低质量内容",
        "description": "判断内容是否属于广告营销、灌水、标题党、引战或明显低价值内容",
        "positive_label": "是",
        "negative_label": "否",
        "reason_options": [
            "广告营销/引流",
            "无意义灌水/凑字数",
            "色情低俗/暴力",
            "政治敏感/违法",
            "诱导点击/标题党",
            "引战/人身攻击",
            "其他低质量",
        ],
    },
    {
        "task_id": AI_GENERATED,
        "ordinal": 2,
        "name": "AI生成内容",
        "description": "判断内容是否呈现明显的 AI 生成特征",
        "positive_label": "是",
        "negative_label": "否",
        "reason_options": [
            "内容空洞套话",
            "句式结构符合AI特征",
            "事实错误/胡编乱造",
            "其他AI特征",
        ],
    },
]
TASK_IDS = [LOW_QUALITY, AI_GENERATED]

# The scoring side describes the same tasks in shorter words.
SCORING_DESCRIPTIONS = {
    LOW_QUALITY: "是否属于低质量内容，包括广告营销、灌水、引战、标题党等",
    AI_GENERATED: "是否呈现明显 AI 生成特征",
}

ANNOTATION_STATUSES = ["unlabeled", "labeled_positive", "labeled_negative"]
ANNOTATION_SOURCES = ["human", "auto", "human_reviewed_auto", "pending"]

# ---- Fixed values: cleaning ----------------------------------------------------------

PREVIEW_CHARS = 200
MIN_ANSWER_CHARS = 20
MIN_RAW_ANSWER_CHARS = 10
DEFAULT_PLATFORM = "zhihu"
CONTACT_PHRASES = [
    "关注我", "公众号", "微信", "vx", "加群", "领资料", "更多干货", "求赞", "求关注", "转载自", "本文首发于",
]
BLOCKED_PAGE_PHRASES = ["系统监测", "验证按钮"]
QUESTION_PREFIX = "问题："
PREVIEW_PREFIX = "回答预览："
ANONYMOUS_AUTHOR = "匿名用户"

# White space as the cleaning and the browser side define it, as regular-expression classes.
WIDE_SPACE = "\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
TEXT_NARROW = "\\t\\n\\x0b\\f\\r\\x1c\\x1d\\x1e\\x1f" "\u0085\u00a0"
TEXT_SPACE = "\\x20" + TEXT_NARROW + WIDE_SPACE
PAGE_NARROW = "\\t\\n\\x0b\\f\\r" "\u00a0"
PAGE_WIDE = WIDE_SPACE + "\ufeff"
PAGE_SPACE = "\\x20" + PAGE_NARROW + PAGE_WIDE
ZERO_WIDTH = "\u200b-\u200d\ufeff"

# Character caps before a model sees the text.
LABEL_CHARS = 1200
TUNING_CHARS = 500
PAGE_CHARS = 3000

# ---- Fixed values: keyword scoring ---------------------------------------------------

LOW_QUALITY_KEYWORDS = [
    "家人们", "谁懂啊", "绝绝子", "yyds", "宝子们", "挖到宝", "赶紧冲", "码住", "太香了", "好哭了", "我真的会谢",
]
LOW_QUALITY_KEYWORDS_BY_PLATFORM = {
    "zhihu": ["谢邀", "先占个坑", "先问是不是", "以上", "互关互赞", "加微信"],
}
AI_KEYWORDS = ["随着", "在当今社会", "综上所述", "由此可见", "一方面", "另一方面", "作为AI"]

VOTE_WEIGHT = 0.6
HIT_CAP = 0.4
HIT_WEIGHT = {LOW_QUALITY: 0.15, AI_GENERATED: 0.18}
SCORE_CUTOFF = {LOW_QUALITY: 0.45, AI_GENERATED: 0.5}
HIT_REASON = {LOW_QUALITY: "命中低质量模式: ", AI_GENERATED: "命中 AI 模式: "}
VOTE_REASON = "RAG 相似样本判断"
NEIGHBORS = 3
MODEL_CONFIDENCE = 0.9
NORMAL_REASON = "Content appears normal"
METHOD_MODEL = "local_model"
METHOD_EXAMPLES = "rag"

# Offline rule used when no scoring result is available; dots are literal.
RULE_KEYWORDS = {
    LOW_QUALITY: ["家人们", "谁懂啊", "绝绝子", "yyds", "宝子们", "挖到宝"],
    AI_GENERATED: ["随着...的发展", "在当今社会", "综上所述", "由此可见"],
}
RULE_STEP = {LOW_QUALITY: 0.15, AI_GENERATED: 0.2}

# ---- Fixed values: rule score of low-quality text -------------------------------------

RULE_SCORE_KEYWORDS = [
    "不看后悔", "震惊", "快看", "必看", "转疯了", "收藏了",
    "干货", "纯干货", "太有用了", "绝了", "yyds", "永远的神",
    "家人们", "谁懂啊", "救命", "我真的", "谁懂", "咱就是说",
    "一整个", "大动作", "狠狠", "绝绝子", "集美", "兄dei",
    "99%", "100%", "赶紧", "马上", "立刻", "速度",
    "免费领", "红包", "福利", "点击领取", "扫码", "加微信",
    "微商", "代购", "赚钱", "副业", "兼职", "日赚",
    "爆款", "热销", "限时", "秒杀", "抢购", "最后一天",
]
REASON_SHORT = "内容过短"
REASON_KEYWORDS = "包含 %d 个低质量关键词"
REASON_PATTERNS = "匹配 %d 个低质量模式"
REASON_SENTENCES = "句子过短"
REASON_SPECIAL = "特殊字符过多"

# ---- Fixed values: model replies and cost ---------------------------------------------

LOCAL_PROVIDER = "local"
PROVIDER_MODELS = {
    "local": "qwen3:8b",
    "doubao": "ark-code-latest",
    "qwen": "qwen-turbo",
    "openai": "gpt-3.5-turbo",
}
RATE_PER_1K = {"doubao": "0.0008", "qwen": "0.001", "openai": "0.01"}
REPLY_PATHS = {
    # provider: (content, prompt token count, reply token count)
    "local": ("$.message.content", None, None),
    "doubao": ("$.choices[0].message.content", "$.usage.prompt_tokens", "$.usage.completion_tokens"),
    "openai": ("$.choices[0].message.content", "$.usage.prompt_tokens", "$.usage.completion_tokens"),
    "qwen": ("$.output.choices[0].message.content", "$.usage.input_tokens", "$.usage.output_tokens"),
}
REVIEW_THRESHOLD = 0.8
FAILED_PREFIX = "预标失败: "
NO_JSON_REASON = "返回格式错误"
UNPARSED_REASON = "解析失败"

# ---- Fixed values: prompt formats ------------------------------------------------------

LABEL_PROMPT_HEAD = """
你是内容审核助手，请对下面输入按多个独立任务分别判断。

任务定义：
{tasks}

输出要求：
1. 只输出 JSON，不要附加解释。
2. JSON 格式必须是：
{{
  "task_results": {{
{schema}
  }}
}}
3. 如果无法判断，可返回 label=null。

待判断内容：
"""
LABEL_TASK_LINE = "- {task_id}: {description}；reason 只能从这些选项里选：{reasons}"
LABEL_SCHEMA_LINE = '    "{task_id}": {{"label": true/false/null, "reason": "原因或空字符串", "confidence": 0.xx}}'

SCORING_PROMPT_HEAD = """
你是内容审核助手，请对以下内容按多个独立任务分别判断。

任务定义：
{tasks}

只输出 JSON，不要任何解释。格式：
{{
  "task_results": {{
{schema}
  }}
}}

内容：
"""
SCORING_TASK_LINE = "- {task_id}: {description}"
SCORING_SCHEMA_LINE = '    "{task_id}": {{"label": true/false/null, "confidence": 0.xx, "reason": "20字以内原因"}}'

SINGLE_PROMPT_HEAD = """请对以下内容执行任务 {task_id}，只输出 JSON：
{{"label":true/false/null}}

内容：
"""
TUNING_PROMPT_HEAD = """请对以下内容执行任务 {task_id}。
任务说明：{description}
只输出 JSON，格式：
{{"label":true/false}}

内容：
"""
PROMPT_TAIL = "\n输出："
TUNING_ANSWERS = {True: '{"label": true}', False: '{"label": false}'}
IGNORED_TOKEN = -100

# ---- Fixed values: pages ----------------------------------------------------------------

PLATFORM_HOSTS = [("xiaohongshu", "xiaohongshu.com"), ("zhihu", "zhihu.com")]
QUESTION_LINK = r"/question/(\d+)"
QUESTION_URL = "https://www.zhihu.com/question/"
LINK_TITLE_CHARS = 200
LINK_CAP = 4000

POST_SIGNALS = ["点赞", "like", "收藏", "collect", "评论", "comment", "分享", "share", "作者", "author"]

ANSWER_PAGE = {
    "title": ".QuestionHeader-title",
    "detail": ".QuestionRichText .RichText",
    "items": ".AnswerItem, .List-item[tabindex]",
    "text": ".RichContent-inner, .RichText",
    "author": '.AuthorInfo-name .UserLink-link, .AuthorInfo-name a, meta[itemprop="name"]',
    "votes": 'button[aria-label*="赞同"] .Button-label, .VoteButton--up .Button-label',
    "comments": 'button:has(.css-1ybo4re), button[aria-label*="评论"]',
}
CARD_PAGE = {
    "cards": [".Feed-item", ".AnswerItem", ".ContentItem", "article"],
    "question": [".ContentItem-title", ".QuestionItem-title", "h2 a", "h2"],
    "page_question": [".QuestionHeader-title"],
    "preview": [".RichContent-inner", ".RichText", '[itemprop="text"]'],
}
POST_CARDS = [
    ".feeds-page .note-item", ".feeds-container .note-item", "[data-v-0d54d578]",
    '[class*="note-item"]', '[class*="explore-feed"]',
    ".search-page .note-item", ".search-result .note-item",
    '[class*="card"]', '[class*="feed"]', '[class*="note"]', '[class*="post"]', "section",
]
DETAIL_REGIONS = [
    ".note-content", ".detail-content", '[class*="content"] article', '[class*="note"] p', "main section",
]

# ---- Fixed values: platform, detector and effect settings ---------------------------------

PLATFORMS = [
    # id, name, url pattern, detectors, effects, enabled
    ("xiaohongshu", "小红书", "https://www.xiaohongshu.com/*", ["ai-content"], ["blur", "label"], True),
    ("zhihu", "知乎", "https://www.zhihu.com/*", ["low-quality"], ["blur", "label"], True),
]
DETECTORS = [
    # id, name, description, enabled, threshold
    ("ai-content", "AI内容检测", "检测AI生成的内容", True, 0.7),
    ("low-quality", "低质量内容检测", "检测低质量/水帖内容", True, 0.6),
]
EFFECTS = [
    # id, name, enabled, options
    ("blur", "虚化效果", True, {"intensity": 8.0}),
    ("label", "标签提示", True, None),
    ("hide", "完全隐藏", False, None),
]
RUNNABLE_DETECTORS = ["ai-content", "low-quality"]
RUNNABLE_EFFECTS = ["blur", "label"]
DETECTOR_TASKS = {"ai-content": AI_GENERATED, "low-quality": LOW_QUALITY}
DETECTOR_LABELS = {"ai-content": "🤖 AI生成内容", "low-quality": "⚠️ 低质量内容"}
OTHER_LABEL = "检测到过滤内容"
CONFIDENCE_LABEL = "置信度: "
BLUR_STRENGTH = 8.0

# ---- Fixed values: default example base -----------------------------------------------------
# text, category, reason if low quality, reason if AI generated

EXAMPLES = [
    ("家人们谁懂啊！今天真的是绝绝子！挖到宝了！这个东西真的是yyds！一定要买！", "xiaohongshu_spam", "广告营销/引流", None),
    ("姐妹们！这个真的太好用了！我已经用了一个月了，皮肤真的变好了！赶紧冲！", "xiaohongshu_ad", "广告营销/引流", None),
    ("家人们！今天给大家分享一个好东西！真的是太香了！不看后悔一辈子！", "clickbait", "标题党/情绪煽动", None),
    ("宝子们！这个真的是绝了！我不允许还有人不知道！赶紧码住！", "xiaohongshu_spam", "广告营销/引流", None),
    ("家人们谁懂啊！这个真的是太好哭了！我真的会谢！", "xiaohongshu_spam", "情绪堆砌/低信息量", None),
    ("在当今社会，人工智能技术的发展日新月异。随着深度学习算法的不断优化，我们在自然语言处理、计算机视觉等领域取得了显著成就。",
     "generic_ai", None, "句式结构符合AI特征"),
    ("随着经济全球化的深入发展，企业面临着前所未有的机遇和挑战。在这样的背景下，如何提升核心竞争力成为了每个企业必须思考的问题。",
     "generic_ai", None, "表达空泛且模板化"),
    ("教育是国之大计、党之大计。培养什么人、怎样培养人、为谁培养人是教育的根本问题。", "generic_ai", None, "句式结构符合AI特征"),
    ("今天去了西湖，人真的很多，但是风景真的很美。拍了很多照片，虽然太阳很大有点晒，但是很开心。", "personal", None, None),
    ("最近在读《活着》，第三次读了，每次都有新的感受。余华的笔力真的太厉害了，富贵的一生让人唏嘘。", "personal", None, None),
    ("今天做了番茄炒蛋，有点咸了，下次少放点盐。不过整体味道还可以，配米饭吃了两大碗。", "personal", None, None),
    ("杭州的春天真的太美了，太子湾的郁金香开了，虽然人挤人，但是看到那么美的花还是觉得值了。", "travel", None, None),
    ("最近在学Python，跟着网上的教程做了一个小爬虫，虽然很简单，但是跑通的时候真的很有成就感！", "tech", None, None),
    ("谢邀。这个问题很简单。先说结论：是的。然后分几点：1. 首先2. 其次3. 最后。以上。", "zhihu_template", "模板化灌水", None),
    ("这个问题我来回答一下。先占个坑，有空再来写。", "zhihu_placeholder", "占坑/无有效信息", None),
    ("先问是不是，再问为什么。", "zhihu_cliche", "低信息量套话", None),
    ("这个问题我刚好有研究。从学术角度来看，主要有三个流派：第一个流派认为...第二个流派认为...第三个流派认为...我个人倾向于第一个流派，因为...",
     "zhihu_quality", None, None),
    ("分享一下我的亲身经历。三年前我也遇到了同样的问题，当时尝试了很多方法都没有用。后来偶然间看到一篇论文，里面提到一个思路，"
     "我试着调整了一下，没想到真的有效。具体来说是这样的...", "personal_experience", None, None),
]
