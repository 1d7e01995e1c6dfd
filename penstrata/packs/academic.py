"""The academic profile."""

#: Rules in order, with their patterns and thresholds.
RULES = [
    {
        "id": "L-CONN-01", "name": "template connectives", "scope": "sentence", "severity": "low",
        "patterns": [
            "首先",
            "其次",
            "再者",
            "此外",
            "与此同时",
            "不仅如此",
            "值得注意的是",
            "值得一提的是",
            "由此可见",
            "不难看出",
            "综上所述",
            "总而言之",
            "一言以蔽之",
            "换言之",
            "更重要的是",
            "尤为重要的是",
            "众所周知",
        ],
    },
    {
        "id": "L-CONN-02", "name": '"first … second" set piece', "scope": "sentence", "severity": "medium",
        "patterns": [
            r"首先[，,].{2,60}[。；;]?\s*其次",
            "^首先[，,]",
        ],
    },
    {
        "id": "L-INFL-01", "name": "significance inflation", "scope": "sentence", "severity": "high",
        "patterns": [
            "标志着",
            "里程碑",
            "分水岭",
            "划时代",
            "历史性(突破|意义|时刻)",
            "具有重要(的)?(意义|价值|作用)",
            "具有深远(的)?(影响|意义)",
            "扮演着.{0,8}(关键|重要)",
            "发挥着.{0,8}(重要|关键)(的)?(作用|角色)",
            "揭示了.{0,16}(本质|规律|机制)",
            "谱写.{0,6}新篇章",
        ],
    },
    {
        "id": "L-COPO-01", "name": "unsupported intensifiers", "scope": "sentence", "severity": "medium",
        "patterns": [
            "显著(提升|提高|增强|改善|降低|减少|优于)",
            "有效(提升|提高|改善|解决|缓解|避免|抑制|降低)",
            "充分(利用|发挥|证明|表明|说明|体现|考虑)",
            "深入(探讨|分析|研究|剖析|挖掘|讨论)",
            "全面(分析|阐述|梳理|揭示|总结|考察|评估)",
            "极大(地)?(提升|提高|丰富|拓展|促进)",
            "在一定程度上(促进|推动|改善|提升|缓解)",
        ],
    },
    {
        "id": "L-FORM-01", "name": "formulaic opening", "scope": "sentence", "severity": "high",
        "patterns": [
            "随着.{2,24}的(快速|不断|迅速|日益|持续)?(发展|进步|推进|深入|普及|提高)",
            "随着科技(的)?发展",
            "在当今(这个)?(快速发展的|信息化|数字化|全球化的?)?时代",
            "在.{2,12}的(背景|大背景|浪潮)下",
            "近年来[，,].{0,40}(受到|获得|引起)(了)?(广泛|越来越多|持续|极大)",
            "日新月异",
        ],
    },
    {
        "id": "L-TAIL-01", "name": "formulaic outlook", "scope": "sentence", "severity": "medium",
        "patterns": [
            "有望(在|为|推动|应用|实现)",
            "(具有|蕴含|展现|展示)(了)?(广阔|巨大|重要|深远|良好)(的)?(应用|研究|发展|理论|市场)(前景|价值|潜力|意义)",
            "值得(进一步|深入)(研究|探讨|探索|关注)",
            "为.{2,20}(提供了|开辟了|指明了)(新的?|明确)?(思路|视角|方法|途径|范式|框架|方向|道路|路径|基础)",
            "奠定(了)?(坚实|重要|良好)(的)?基础",
            "(打下了|奠定)(了)?(坚实|良好|牢固)(的)?(基础|根基)",
        ],
    },
    {
        "id": "L-HYPE-01", "name": "policy buzzwords", "scope": "sentence", "severity": "medium",
        "patterns": [
            "赋能",
            "(重要|主要)?抓手",
            "(形成|构建|打造).{0,6}闭环",
            "底层逻辑",
            "顶层设计",
            "(降维打击|护城河|组合拳|快车道|新引擎|定海神针|压舱石)",
            "深度融(合|入)",
            "有力(支撑|保障|助推)",
        ],
    },
    {
        "id": "L-NEGA-01", "name": '"not only … but" parallelism', "scope": "sentence", "severity": "low",
        "patterns": [
            "不仅.{2,24}(，|、)?(而且|更是|还|甚至|也)",
            "不是.{2,24}(，|、)?而是",
            "并非.{2,24}(，|、)?(而是|只是)",
            "既.{2,16}(，|、)?又.{2,16}(，|、)?更",
        ],
    },
    {
        "id": "L-EVADE-01", "name": "copula avoidance", "scope": "sentence", "severity": "low",
        "patterns": [
            "扮演着",
            "充当.{0,10}(的)?(角色|作用|桥梁|媒介)",
            "作为.{2,16}(的)?(重要|关键|核心)(组成|载体|途径|手段|工具|环节)",
        ],
    },
    {
        "id": "L-PAD-01", "name": '"carry out" padding', "scope": "sentence", "severity": "medium",
        "patterns": [
            "进行(了|着)(全面|系统|深入|详细|细致|广泛)(的)?(分析|研究|探讨|阐述|论述|考察|梳理|总结)",
            "做出(了)?(重要|巨大|突出)(的)?贡献",
            "取得(了)?(显著|重要|长足)(的)?(进展|成效|成果|突破)",
            "开展(了)?(系统|深入|全面)(的)?(研究|分析|实验)",
        ],
    },
    {
        "id": "L-AIM-01", "name": "boilerplate study statement", "scope": "sentence", "severity": "medium",
        "patterns": [
            "研究旨在",
            "旨在(探讨|评估)",
            "(研究|实验)结果(表明|显示)",
            "提供了(理论|实验)依据",
        ],
    },
    {
        "id": "S-OPEN-01", "name": "speech-style opening", "scope": "sentence", "severity": "high",
        "patterns": [
            "让我们(一起|共同|先|首先|来)",
            "接下来(，)?(我们)?(将|来)?(介绍|探讨|分析|看看)",
            "下面(将|我)?(介绍|分析|探讨|开始)",
            "本文将(带|带领)大家",
        ],
    },
    {
        "id": "S-CLOS-01", "name": "one-sentence closing paragraph", "scope": "shape", "severity": "low",
    },
    {
        "id": "D-UNIF-01", "name": "even sentence lengths", "scope": "doc", "severity": "medium",
        "metric": "sentence_cv", "compare": "below", "threshold": 0.37, "tiers": [(300, 0.3), (600, 0.33), (None, 0.37)],
    },
    {
        "id": "D-CONN-01", "name": "dense connectives", "scope": "doc", "severity": "low",
        "metric": "conn_density", "compare": "above", "threshold": 0.08,
    },
    {
        "id": "D-PARA-01", "name": "even paragraph lengths", "scope": "doc", "severity": "low",
        "metric": "para_len_cv", "compare": "below", "threshold": 0.25,
    },
    {
        "id": "D-NGRAM-01", "name": "repeated four-grams", "scope": "doc", "severity": "low",
        "metric": "ngram_repeat", "compare": "above", "threshold": 0.15,
    },
    {
        "id": "D-DASH-01", "name": "frequent dashes", "scope": "doc", "severity": "low",
        "metric": "dash_density", "compare": "above", "threshold": 0.15,
    },
]

#: The fitted model; tiers replace its coefficients from a length on.
SCORING = {
    "intercept": -69.8327,
    "hit_density": 8.9025,
    "sentence_cv": -14.8899,
    "ttr": 83.377,
    "ngram_repeat": 22.6387,
    "p50": 15,
    "p90": 63,
    "tiers": [{'min_chars': 600, 'intercept': -79.959, 'hit_density': 1.7466, 'sentence_cv': -6.0175, 'ttr': 89.2265, 'ngram_repeat': 37.0485}],
}
