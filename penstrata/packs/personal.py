"""The personal profile."""

#: Rules in order, with their patterns and thresholds.
RULES = [
    {
        "id": "T-VOICE-01", "name": "consolation", "scope": "sentence", "severity": "high",
        "taste": "T1",
        "patterns": [
            "[，,].{0,14}(跑不了|还在原地|不丢人|不算熬夜|是正常|别硬撑|又不会跑|不会跑)",
            "[，,——]{1,2}(正常|没关系|没事的)[。！]?$",
            "(谁也躲不过|躲不过|都这样|都会过去|一切都会(好起来|变好|过去|好的))[。！]?$",
            "(别急|别慌|慢慢来)[，,].{0,12}(还|总|会|能)",
            "你已经(很|够|超|挺|那么|这么).{0,3}(棒|好|努力|优秀|坚强|辛苦|了不起)",
            "不要给自己(太大|太多|过多)?(压力|负担)",
            "好好(爱|善待|心疼)?自己",
            "你值得(拥有|被爱|世间|这世界|一切|最好|所有)",
            "(会一直|一直|永远)陪(着|在)?你",
            "(请)?记得?(好好)?(照顾|爱惜|犒劳)好?自己",
        ],
    },
    {
        "id": "T-VOICE-02", "name": "lyrical uplift", "scope": "sentence", "severity": "high",
        "taste": "T2",
        "patterns": [
            "[，,](就是|才是|是)(最好的|你的|一场|偷来的|属于)",
            "陪你|伴你|照亮你的",
            "[，,][^，,]{0,4}越[^，,]{1,8}",
        ],
    },
    {
        "id": "T-VOICE-03", "name": "excuses by negation", "scope": "sentence", "severity": "medium",
        "taste": "T3",
        "patterns": [
            "不是.{0,8}(问题|错|摆烂|态度|罪|偷懒|偷闲)",
            "(是科学|是生理学|不心虚|才怪)",
        ],
    },
    {
        "id": "T-VOICE-04", "name": "promised efficiency", "scope": "sentence", "severity": "medium",
        "taste": "T4",
        "patterns": [
            "(效率|产出)(翻倍|提升|暴涨)",
            "(十倍|翻番).{0,4}(效率|速度)",
        ],
    },
    {
        "id": "T-VOICE-05", "name": "exhortation", "scope": "sentence", "severity": "medium",
        "taste": "T5",
        "patterns": [
            ".{2,}[，,].{0,10}(早点睡|早点休息|注意身体|保重身体|照顾好身体)",
            "(别|不要)(熬太晚|熬夜|硬撑|逞强).{0,12}[，,].{1,20}",
            "(记得|要)(喝水|吃饭|休息)[，,]",
        ],
    },
    {
        "id": "T-VOICE-06", "name": "flattery by comparison", "scope": "sentence", "severity": "medium",
        "taste": "T6",
        "patterns": [
            "(太阳|月亮|星星|别人)还没你",
            "比(月亮|太阳|谁都)还?",
            "(最棒|最强|最努力|最优秀)的?你",
        ],
    },
    {
        "id": "T-VOICE-07", "name": '"you who" frame', "scope": "sentence", "severity": "high",
        "taste": "T7",
        "patterns": [
            "^[^，,]{0,10}的你[，,]",
            "(凌晨|深夜|清晨|此刻|现在)的?你[，,]",
        ],
    },
    {
        "id": "T-VOICE-08", "name": "superlatives of mankind", "scope": "sentence", "severity": "medium",
        "taste": "T8",
        "patterns": [
            "(人类|世界|宇宙|所有人|全场|打工人|社畜)的?(至暗|巅峰|终极|最高|最低|荣光)",
        ],
    },
    {
        "id": "T-VOICE-09", "name": "asides to the reader", "scope": "sentence", "severity": "medium",
        "taste": "T9",
        "patterns": [
            r"——\s*你.{0,4}(也|又|总是|还是)",
            "你不是(说|讲)过",
        ],
    },
    {
        "id": "T-VOICE-10", "name": "slogans", "scope": "sentence", "severity": "low",
        "taste": "T10",
        "patterns": [
            "(好好|认真)(读|学|干|写)",
            "(加油|稳住|你可以的|冲鸭)",
            "(这波|这把|这次)稳",
            "(都|也)没倒下",
            "主打一个",
            "(主线|支线|日常|今日)任务[:：]",
            "(喝口水|歇一会|喘口气).{0,6}(再战|再来|继续)",
        ],
    },
    {
        "id": "T-VOICE-11", "name": "summing-up words", "scope": "sentence", "severity": "low",
        "taste": "T12",
        "patterns": [
            "(综上所述|总而言之|总的来说|由此可见|不得不说)",
        ],
    },
    {
        "id": "T-VOICE-12", "name": "jingles", "scope": "sentence", "severity": "low",
        "taste": "T10",
        "patterns": [
            "(不|没).{1,6}[，,].{1,8}(崩溃|完蛋|报废|废了|白搭)",
        ],
    },
    {
        "id": "T-MANUAL-01", "name": "instruction voice: automation", "scope": "sentence", "severity": "high",
        "taste": "T11",
        "patterns": [
            "(自动|智能)(挑|选|匹配|生成|识别|分析).{0,6}(相关|内容|结果)?",
            "先.{1,4}再.{1,4}(作答|回答|生成|处理)",
            "一次最多.{0,6}(篇|条|个|张)",
            "(请直接|直接)(问|输入|点)",
            "(勾选|选中)的.{0,8}(以|用).{0,6}(参与|加入)",
        ],
    },
    {
        "id": "T-MANUAL-02", "name": "instruction voice: gestures", "scope": "sentence", "severity": "medium",
        "taste": "T11",
        "patterns": [
            "(点击|单击|拖入|拖拽|勾选|按下|右键).{0,12}(选择|上传|导入|打开|完成)",
            "(esc|Esc|回车|快捷键).{0,6}(取消|确认)",
            "(支持|可以|可)先?.{0,6}(导入|导出|批量|离线|多选)",
        ],
    },
    {
        "id": "T-MANUAL-03", "name": "instruction voice: parts", "scope": "sentence", "severity": "low",
        "taste": "T11",
        "patterns": [
            "(批注台|工作台|控制台|中枢|引擎|模块)$",
        ],
    },
    {
        "id": "T-DASH-01", "name": "frequent dashes", "scope": "doc", "severity": "low",
        "taste": "T12",
        "metric": "dash_density", "compare": "above", "threshold": 0.2,
    },
]

SCORING = None
