"""Documents derived from the order tables, so that every operator meets text of its language.

The same documents can be made by any SQL engine; see ``plans.oracles``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from penstrata.session import table

#: Our own sentences; {q} is the line item's quantity. Some hit rules, some are plain.
BANK = [
    "随着科技的发展，旧仓库里的灯一盏接一盏换成了新的。",
    "早上八点，他把{q}箱橘子搬到院子门口。",
    "不得不说，这条路在雨后格外难走！",
    "我们的方案不仅省下了运费，而且让老人少走两趟楼梯。",
    "她记下今天的账，合上本子，去巷口买豆浆。",
    "这次改造赋能了整条生产线，也让师傅们学会看图纸。",
    "总之，先把货送到再谈价钱？",
    "河边的柳树、石桥、渡船都是他小时候常见的。",
    "近日，镇上的集市多了{q}个卖竹器的摊子。",
    "首先，核对单据；其次，清点件数。",
    "欢迎在评论区告诉我你家乡的年味。",
    "仓管员老周说话慢，做事却从不拖到第二天。",
    "会议强调要切实做好防汛，进一步落实到人。",
    "夜里风大——窗纸一直响——谁也没有睡踏实。",
    "这项工作具有重要的意义，值得深入研究。",
    "他数了数，还差{q}张票，就给车站打了电话。",
    "据悉，新桥将在秋天通车。",
    "众所周知，腌菜要压石头。",
    "镜头语言很克制，人物弧光却写得太满。",
    "孩子们在操场上追一只黄狗，笑声传得很远！",
    "此外，运输途中的损耗被控制在{q}件以内。",
    "深夜的你，辛苦了，慢慢来，一切都会好的。",
    "标志着老厂区的改建进入第二个阶段。",
    "雨停以后，屋檐下的水一滴一滴落进缸里。",
    "新炉子显著降低了煤耗，也省下{q}块钱。",
    "这座木桥扮演着两岸往来的要道。",
    "他们对旧账本进行了全面的梳理。",
    "本研究旨在探讨竹器的寿命。",
    "让我们先看一看仓库的门。",
    "学徒们用双手谱写新的篇章。",
    "正如老周所说，货比三家不吃亏。",
    "这场大雨引发了热议。",
    "值得注意的是，秤要先校准。",
    "相信在大家的共同努力下，堤坝会更牢。",
    "睡不着，没关系。",
    "巷口一盏灯，就是最好的路标。",
    "这不是态度问题。",
    "换了新秤，效率翻倍。",
    "忙到几点都行，早点睡。",
    "太阳还没你起得早。",
    "那是打工人的至暗时刻。",
    "你不是说过要来吗？",
    "加油，稳住！",
    "字没写完，人先崩溃。",
    "系统会自动匹配相关内容。",
    "点击左上角选择文件。",
    "左手边是批注台",
    "影片讲述了一家三代的故事。",
    "他说：“先别急！等我看看。”然后走了。",
    "『“先装车！”老周喊。』大家才动手。",
    "账本上写着\"欠{q}元。未还！\"几个字。",
    "他写道”不急。第二天又来。",
    "柜里有旧瓷碗、粗陶罐、细竹篾编成的提篮等物件。",
    "邮件里附了三份日志，稿子还没动。",
    "深入分析表明，水位每天退一寸。",
    "站台上空无一人；钟敲了{q}下。",
    "她把伞留给了送信的人，自己淋着雨回家。",
    "电话是13800138000，邮箱写在封底。",
]
#: Our own whole documents, one after another for every 40th customer from 0 on: out of domain in every way, or of no sentence.
SPECIAL = [
    "昔有渔者居于江滨，日出而渔，日入而息。客问曰：汝何以不货于市？渔者曰：鱼之大者留以养母，小者纵之归渊，吾何货焉。客叹曰：世皆逐利，汝独守拙，贤矣哉。渔者笑而不答，鼓枻而去。客遂记其言于石，以示后之来者。或疑其事无稽，然江上父老皆能道之矣。",
    "春水绕村流，老牛踏月归。木桥通小市，竹舍近长堤。远岸停新棹，空山响暮钟。夜雨敲窗急，晨炊出巷迟。田头三亩豆，井畔一株梨。雁过留残影，潮来带细沙。旧友隔江住，新茶对客斟。灯前修破网，檐下补寒衣。雪压松枝重，风吹麦浪低。",
    "各乡镇人民政府：现将《河道清淤办法》印发给你们，请结合实际抓好落实。清淤分三段进行，每段两个月。第一段自上游水闸起。第二段到老石桥为止。第三段直达入海口。所需土方车由县里统一调配。工钱按月结清。各村自备铁锹和箩筐。完工之后由水利站验收。",
    "青石镇：你镇关于新建渡口的请示收悉。经研究，现批复如下：同意在旧码头以东新建渡口一处。渡船不超过两条。船工须有三年以上经验。汛期停渡。票价按原标准执行。渡口两侧各留二十步空地。夜间须点灯两盏。其余事项由你镇自行安排。竣工后报县里备案。",
    "为深入贯彻防汛工作会议精神，切实做好度汛准备，扎实推进堤防加固，进一步压实责任。各站要切实值守，持续巡查——不留死角——不漏一处。物资要切实备足——草袋、木桩、油布——逐项登记。扎实演练一次。进一步核对名册。持续通报水情。切实保障电话畅通。扎实收尾。特此通知。",
    "The old warehouse stands by the river; nobody has opened its doors for years! Boats pass in the morning and return in the evening; the clerk writes down their numbers? He keeps two books; one for grain and one for cloth! When it rains the roof leaks; buckets stand in a row. At night the lamp burns low; the dog sleeps.",
    "！！！？？？……。。。",
    "春水绕村流，老牛踏月归。木桥通小市，竹舍近长堤。远岸停新棹，空山响暮钟。夜雨敲窗急，晨炊出巷迟。田头三亩豆，井畔一株梨。雁过留残影，潮来带细沙。旧友隔江住，新茶对客斟。灯前修破网，檐下补寒衣。雪压松枝重，风吹麦浪低。\n\n后来他把这几行字抄在墙上，来往的人都停下来念一遍。有人嫌它太旧，有人觉得正好。墙皮一年年剥落，字也一年年淡下去。",
]
EVERY = 40
#: Line templates for the Markdown view; {k} is the order's key.
MARKDOWN = [
    "# 第{k}号记录",
    "- 清点**旧账本**的页数。",
    "正文写在这里，见 [说明](http://a.example/{k}) 一行。",
    "> 引用的一句话。",
    "```",
    "| 名称 | 数量 {k} | 备注 |",
    "|---|---|---|",
    "",
    "1. 先称重；再装箱。",
    "第二段没有标点 mail{k}@b.example 结尾",
    "----",
    "* [x] 已经办完的事！",
    "接着写一句。然后再写一句？",
    "===",
]


def zh_docs(spark: SparkSession, sf_dir: str, step: int = 7, between: str = "") -> DataFrame:
    """(doc_id, text): a document per customer, a paragraph per order, a sentence per line item.

    ``step`` makes another version, ``between`` stands between sentences. Some
    customers have a document of SPECIAL instead.
    """
    item = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity")
    order = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    at = (F.col("l_orderkey") * step + F.col("l_linenumber") * 13 + F.col("l_partkey") * 5 + F.col("l_suppkey")) % len(BANK) + 1
    bank = F.array(*[F.lit(s) for s in BANK])
    text = F.replace(F.element_at(bank, at.cast("int")), F.lit("{q}"), F.col("l_quantity").cast("int").cast("string"))
    rows = item.join(order, F.col("l_orderkey") == F.col("o_orderkey")).select("o_custkey", "l_orderkey", "l_linenumber", text.alias("s"))
    joined = lambda c, sep: F.array_join(F.transform(F.array_sort(c), lambda x: x["s"]), sep)
    paras = rows.groupBy("o_custkey", "l_orderkey").agg(joined(F.collect_list(F.struct("l_linenumber", "s")), between).alias("s"))
    docs = paras.groupBy("o_custkey").agg(joined(F.collect_list(F.struct("l_orderkey", "s")), "\n\n").alias("text")).withColumnRenamed("o_custkey", "doc_id")
    special = F.element_at(F.array(*[F.lit(s) for s in SPECIAL]), (F.col("doc_id") % EVERY + 1).cast("int"))
    return docs.select("doc_id", F.when(F.col("doc_id") % EVERY < len(SPECIAL), special).otherwise(F.col("text")).alias("text"))


def md_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, text): a document per customer, a Markdown line per order."""
    order = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    lines = F.array(*[F.lit(s) for s in MARKDOWN])
    text = F.replace(F.element_at(lines, ((F.col("o_orderkey") * 5 + F.col("o_custkey") * 3) % len(MARKDOWN) + 1).cast("int")), F.lit("{k}"), F.col("o_orderkey").cast("string"))
    return order.groupBy(F.col("o_custkey").alias("doc_id")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("o_orderkey", text.alias("s")))), lambda x: x["s"]), "\n").alias("text"))
