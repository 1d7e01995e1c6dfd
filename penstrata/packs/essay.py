"""The essay profile."""

#: Rules in order, with their patterns and thresholds.
RULES = [
    {
        "id": "E-NEGA-01", "name": "lift by negation", "scope": "sentence", "severity": "high",
        "patterns": [
            "不是.{2,24}(，|、)?而是",
            "不仅.{2,24}(，|、)?(而且|更是|还|甚至|也)",
            "(不仅仅是?).{2,20}(更是|还是|更是对)",
        ],
    },
    {
        "id": "E-SUB-01", "name": "sublimation", "scope": "sentence", "severity": "medium",
        "patterns": [
            "(谱写|书写|绘就).{0,8}(篇章|华章|画卷)",
            "(绽放|散发).{0,6}(光彩|光芒)",
            "(青春|奋斗)(的)?(风采|底色|模样)",
            "找到属于自己的",
            "在人生的道路上",
        ],
    },
    {
        "id": "E-FORM-01", "name": "formulaic opening", "scope": "sentence", "severity": "medium",
        "patterns": [
            "随着.{2,24}的(快速|不断|迅速|日益|持续)?(发展|进步|推进|深入|普及|提高)",
            "在当今(这个)?(快速发展的|信息化|数字化|全球化的?)?时代",
            "在.{2,12}的(背景|大背景|浪潮)下",
            "在这个(信息爆炸|快节奏|数字化|互联网|发展迅速|日新月异)?(的)?时代",
            "(信息爆炸)(的)?(社会|时代)",
            "快节奏的(时代|生活|社会)",
            "日新月异",
        ],
    },
    {
        "id": "E-CONN-01", "name": "connectives", "scope": "sentence", "severity": "low",
        "patterns": [
            "首先",
            "其次",
            "再者",
            "此外",
            "与此同时",
            "不仅如此",
            "由此可见",
            "综上所述",
            "总而言之",
            "一言以蔽之",
            "更重要的是",
        ],
    },
    {
        "id": "E-QUOTE-01", "name": "quoted authority", "scope": "sentence", "severity": "low",
        "patterns": [
            "正如.{2,12}(所说|所言|而言)",
            "有一句话(说得好|这样说道)",
            "古人(云|曰|说)",
            "习近平总书记曾指出",
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
        "metric": "sentence_cv", "compare": "below", "threshold": 0.4, "tiers": [(600, 0.42)],
    },
]

#: The fitted model; tiers replace its coefficients from a length on.
SCORING = {
    "intercept": -44.1715,
    "hit_density": 9.6652,
    "sentence_cv": -16.2585,
    "ttr": 53.8539,
    "ngram_repeat": 3.8401,
    "p50": 5,
    "p90": 55,
    "tiers": [],
}
