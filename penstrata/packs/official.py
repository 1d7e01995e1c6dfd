"""The official profile."""

#: Rules in order, with their patterns and thresholds.
RULES = [
    {
        "id": "O-STK-01", "name": "adverb lexicon", "scope": "lexicon", "severity": "medium",
        "patterns": [
            "切实",
            "扎实",
            "进一步",
            "持续",
            "不断",
            "深入",
            "全面",
            "有力",
            "有效",
            "扎实推进",
            "大力",
            "着力",
        ],
    },
    {
        "id": "O-TAIL-01", "name": "speech ending", "scope": "sentence", "severity": "high",
        "patterns": [
            "相信在.{2,16}的(共同|携手)努力下",
            "让我们(以更加|携手|共同|以)",
            "(使命|任务)光荣、?责任重大",
            "奋力开创新局面",
            "奋力谱写",
            "以优异成绩",
        ],
    },
    {
        "id": "O-EXCL-01", "name": "exclamation mark", "scope": "sentence", "severity": "high",
        "patterns": [
            "[!！]",
        ],
    },
    {
        "id": "D-STKD-01", "name": "dense adverbs", "scope": "doc", "severity": "low",
        "metric": "conn_density", "compare": "above", "threshold": 0.55,
    },
    {
        "id": "D-PARA-01", "name": "even paragraph lengths", "scope": "doc", "severity": "low",
        "metric": "para_len_cv", "compare": "below", "threshold": 0.25,
    },
    {
        "id": "D-DASH-01", "name": "frequent dashes", "scope": "doc", "severity": "low",
        "metric": "dash_density", "compare": "above", "threshold": 0.15,
    },
]

#: The fitted model; tiers replace its coefficients from a length on.
SCORING = {
    "intercept": 44.4248,
    "hit_density": 23.6565,
    "sentence_cv": 3.0339,
    "ttr": -44.333,
    "ngram_repeat": -66.8477,
    "p50": 4,
    "p90": 58,
    "genre_ood": True,
    "genres": {"issuance-notice": {"suppress": True}, "approval-reply": {"suppress": True}},
    "tiers": [],
}
