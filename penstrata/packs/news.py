"""The news profile."""

#: Rules in order, with their patterns and thresholds.
RULES = [
    {
        "id": "N-INTERACT-01", "name": "engagement tail", "scope": "sentence", "severity": "high",
        "patterns": [
            "欢迎在评论区",
            r"(点赞|收藏|转发|关注)(加|\+|、)?(收藏|转发|关注|走起)?",
            "希望这篇(文章|内容)?(对你)?(有所|有)?帮助",
            "如果(您|你)还有(其他|别的|任何)?(问题|疑问)",
            "让我们(一起|共同)?(期待|学习|进步)",
            "你们的(支持|点赞)就是",
        ],
    },
    {
        "id": "N-RECENT-01", "name": "vague time", "scope": "sentence", "severity": "medium",
        "patterns": [
            "近日[，,]?",
            "最近[，,]?.{0,10}(引发|引起|传出)",
        ],
    },
    {
        "id": "N-HEARSAY-01", "name": "vague source", "scope": "sentence", "severity": "low",
        "patterns": [
            "据悉",
            "(有关|相关)(负责人|人士|部门)表示",
            "有(专家|学者|网友)认为",
            "分析人士(指出|认为|表示)",
            "数据显示",
            "接受(媒体)?采访时",
        ],
    },
    {
        "id": "N-BUZZ-01", "name": "buzz", "scope": "sentence", "severity": "medium",
        "patterns": [
            "(引发|引起|受到|吸引)(了)?(社会各界的?)?(广泛|高度|热烈|强烈)关注",
            "的广泛关注",
            "引发(了)?(热议|轰动)",
        ],
    },
    {
        "id": "N-NOTE-01", "name": "editorial note", "scope": "sentence", "severity": "low",
        "patterns": [
            "值得注意的是",
            "值得一提的是",
            "总体(来看|而言)",
            "总的来看",
        ],
    },
    {
        "id": "L-CONN-01", "name": "template connectives", "scope": "sentence", "severity": "low",
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
        ],
    },
    {
        "id": "D-UNIF-01", "name": "even sentence lengths", "scope": "doc", "severity": "medium",
        "metric": "sentence_cv", "compare": "below", "threshold": 0.4, "tiers": [(300, 0.36)],
    },
]

#: The fitted model; tiers replace its coefficients from a length on.
SCORING = {
    "intercept": -62.6212,
    "hit_density": 7.0997,
    "sentence_cv": -5.1318,
    "ttr": 67.7646,
    "ngram_repeat": -3.1777,
    "p50": 6,
    "p90": 55,
    "tiers": [],
}
