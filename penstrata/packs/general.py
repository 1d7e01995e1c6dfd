"""The general profile."""

#: Rules in order, with their patterns and thresholds.
RULES = [
    {
        "id": "G-OPEN-01", "name": "stock opening", "scope": "sentence", "severity": "high",
        "patterns": [
            "在这个(信息爆炸|快节奏|数字化|互联网|发展迅速|日新月异)?(的)?时代",
            "随着科技(的)?(发展|进步)",
            "随着社会(的)?(发展|进步)",
            "相信很多(人|朋友|读者)",
            "你有没有(发现|想过|遇到)",
            "说起.{2,12}(，)?相信",
            "不知道你有没有",
            "^(好的|没问题|当然)[，,!！]",
            "^(好的|没问题)[，,]?(关于|针对|就)",
            "以下是(关于|一些建议|针对|详细)",
            "针对(您|你)的(问题|情况|需求)",
        ],
    },
    {
        "id": "G-INTERACT-01", "name": "engagement tail", "scope": "sentence", "severity": "high",
        "patterns": [
            "欢迎在评论区",
            r"(点赞|收藏|转发|关注)(加|\+|、)?(收藏|转发|关注|走起)?",
            "希望这篇(文章|内容)?(对你)?(有所|有)?帮助",
            "对你有所?帮助",
            "希望能(帮助|帮到)(到)?(你|大家)",
            "如果(您|你)还有(其他|别的|任何)?(问题|疑问)",
            "(祝|祝愿)你(生活愉快|学习进步|工作顺利|使用愉快)",
            "以上就是(关于|本次|全部)?",
            "我们下期(再见|见)",
            "希望对你有所(启发|帮助)",
            "让我们(一起|共同)?(期待|学习|进步)",
            "如果你有(什么)?(问题|想法|不同意见)",
            "你们的(支持|点赞)就是",
        ],
    },
    {
        "id": "G-HYPE-01", "name": "hot words", "scope": "sentence", "severity": "medium",
        "patterns": [
            "赋能",
            "底层逻辑",
            "顶层设计",
            "降维打击",
            "(形成|构建|打造|玩转).{0,4}闭环",
            "(重要|主要)?抓手",
            "天花板(级)?",
            "满满的?干货",
            "无脑(冲|选|入)",
            "吊打",
            "碾压(级)?",
            "断层(第一|领先)",
        ],
    },
    {
        "id": "G-SAFE-01", "name": "hedging", "scope": "sentence", "severity": "low",
        "patterns": [
            "不得不说",
            "不可否认",
            "毋庸置疑",
            "众所周知",
            "总的来说",
            "总体而言",
            "总之",
            "综上所述",
            "总而言之",
        ],
    },
    {
        "id": "G-TRIAD-01", "name": "three-item enumeration", "scope": "sentence", "severity": "low",
        "patterns": [
            r"[\u4e00-\u9fa5]{2,8}[、][\u4e00-\u9fa5]{2,8}[、][\u4e00-\u9fa5]{2,8}(?!等)",
        ],
    },
    {
        "id": "D-UNIF-01", "name": "even sentence lengths", "scope": "doc", "severity": "medium",
        "metric": "sentence_cv", "compare": "below", "threshold": 0.35,
    },
    {
        "id": "D-PARA-01", "name": "even paragraph lengths", "scope": "doc", "severity": "low",
        "metric": "para_len_cv", "compare": "below", "threshold": 0.25,
    },
    {
        "id": "D-NGRAM-01", "name": "repeated four-grams", "scope": "doc", "severity": "low",
        "metric": "ngram_repeat", "compare": "above", "threshold": 0.15,
    },
]

#: The fitted model; tiers replace its coefficients from a length on.
SCORING = {
    "intercept": -58.3795,
    "hit_density": 6.1082,
    "sentence_cv": -5.991,
    "ttr": 65.0166,
    "ngram_repeat": -107.8282,
    "p50": 2,
    "p90": 58,
    "tiers": [],
}
