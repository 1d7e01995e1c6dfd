"""The review profile."""

#: Rules in order, with their patterns and thresholds.
RULES = [
    {
        "id": "R-ANALYT-01", "name": "analyst labels", "scope": "sentence", "severity": "medium",
        "patterns": [
            "镜头语言",
            "叙事(节奏|结构)的?把握",
            "(电影|影片)的?(美学|质感)|(视觉|美学)风格",
            "人物弧光",
        ],
    },
    {
        "id": "R-RECAP-01", "name": "plot recap", "scope": "sentence", "severity": "medium",
        "patterns": [
            "(影片|电影|该剧|本剧|这本书)?讲述了",
            "故事(发生|围绕)在",
            "(讲述|描绘)了.{0,16}(的)?故事",
        ],
    },
    {
        "id": "L-NEGA-01", "name": '"not only … but" parallelism', "scope": "sentence", "severity": "low",
        "patterns": [
            "不仅.{2,24}(，|、)?(而且|更是|还|甚至|也)",
            "不是.{2,24}(，|、)?而是",
            "(不仅仅?是).{2,20}(更是|还是)",
        ],
    },
]

SCORING = None
