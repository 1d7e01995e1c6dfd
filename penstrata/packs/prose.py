"""Why a rule matters and what to do instead, by rule. Profiles share rules of one id and so their prose."""

from __future__ import annotations

#: rule id: (why it is told, what to do instead, a sentence that hits, the same said better)
PROSE: dict[str, tuple[str, str, str, str]] = {
    "L-CONN-01": ("Stock connectives announce an order that the argument should show by itself.", "Drop the word; keep it only where the relation would be unclear.", "此外，成本下降了。", "成本也下降了。"),
    "L-CONN-02": ("A first-second set piece lists points without weighing them.", "Lead with the point that matters and tie the others to it.", "首先核对单据；其次清点件数。", "核对单据时一并清点件数。"),
    "L-INFL-01": ("The sentence claims historic weight that nothing in it supports.", "State what changed and by how much.", "这标志着厂区进入新阶段。", "厂区从三月起改烧天然气。"),
    "L-COPO-01": ("An intensifier stands where a figure should.", "Give the figure or cut the adverb.", "显著提升了产量。", "产量提高了12%。"),
    "L-FORM-01": ("The opening would fit any text on any subject.", "Begin with what only this text has to say.", "随着科技的发展，仓库也变了。", "仓库去年换了自动货架。"),
    "L-TAIL-01": ("The ending promises significance instead of closing the argument.", "End on the last result or the next concrete step.", "具有广阔的应用前景。", "下一步在两个渡口试装。"),
    "L-HYPE-01": ("A buzzword hides who does what.", "Name the actor and the action.", "赋能生产线。", "给生产线加装了计数器。"),
    "L-NEGA-01": ("Denying one thing to lift another is a rhythm, not a reason.", "State the second half and prove it.", "不仅省钱，而且省时。", "每车省四十分钟。"),
    "L-EVADE-01": ("A grand verb replaces a plain statement of what something is.", "Say that it is, or what it does.", "扮演着重要角色。", "这座桥每天过三千人。"),
    "L-PAD-01": ("A noun phrase with a light verb pads what one verb says.", "Use the verb.", "进行了深入的分析。", "分析了三年的账。"),
    "L-AIM-01": ("Boilerplate of study reports says nothing of this study.", "Ask the question that the study answers.", "本研究旨在探讨寿命。", "竹器能用几年？"),
    "S-OPEN-01": ("An invitation to the audience belongs to a speech.", "Start with the subject.", "让我们先看一看大门。", "大门朝东。"),
    "S-CLOS-01": ("A paragraph of one short sentence stamps a conclusion on what went before.", "Join it to the paragraph that it sums up, or cut it.", "这就是答案。", "（并入上一段）"),
    "D-UNIF-01": ("Sentences are of nearly one length throughout.", "Let length follow the thought: some short, some long.", "", ""),
    "D-CONN-01": ("Connectives stand closer together than in most writing of this kind.", "Cut every one that the order of sentences makes plain.", "", ""),
    "D-PARA-01": ("Paragraphs are of nearly one length.", "Break where the subject changes, not where the page does.", "", ""),
    "D-NGRAM-01": ("The same runs of characters come back again and again.", "Vary or remove the repeated wording.", "", ""),
    "D-DASH-01": ("Dashes are frequent.", "Use commas or full stops; keep a dash for a real break.", "", ""),
    "E-NEGA-01": ("The sentence lifts itself by denying something nobody said.", "Say the positive half alone.", "不是结束，而是开始。", "从这天起他每周来一次。"),
    "E-SUB-01": ("The feeling is raised beyond what the story carries.", "Stay with what was seen and done.", "谱写了新的篇章。", "他们把桥修好了。"),
    "E-FORM-01": ("The opening would fit any essay.", "Begin in the scene.", "在这个快节奏的时代，人人都忙。", "早上八点，巷口还没人。"),
    "E-CONN-01": ("Connectives of an outline stand in for the movement of the story.", "Let one event lead to the next.", "首先，我出了门。", "我出了门。"),
    "E-QUOTE-01": ("An authority is quoted in place of one's own reason.", "Say it in your own words, or say where it was said.", "正如老周所说，货比三家。", "我比了三家才买。"),
    "G-TRIAD-01": ("Three items of one shape are a rhythm that writers seldom need.", "Name the one or two that count.", "桥、路、树都旧了。", "桥最旧。"),
    "G-OPEN-01": ("A stock opening delays the answer.", "Give the answer first.", "随着科技的发展，选择多了。", "选第二种。"),
    "G-INTERACT-01": ("The ending asks for attention instead of finishing.", "Stop when the matter is finished.", "欢迎在评论区留言。", "（删去）"),
    "G-HYPE-01": ("A hot word stands for an explanation.", "Explain in plain words what happens.", "形成闭环。", "退货由原车带回。"),
    "G-SAFE-01": ("A hedge commits to nothing.", "Say it, or leave it out.", "总之很好。", "很好。"),
    "N-INTERACT-01": ("A report does not ask its readers for favours.", "Close with the last fact.", "欢迎在评论区讨论。", "（删去）"),
    "N-RECENT-01": ("The time is vague.", "Give the date.", "近日，集市开张。", "集市三月五日开张。"),
    "N-HEARSAY-01": ("The source is nobody in particular.", "Name the source or drop the claim.", "据悉，新桥将通车。", "县交通局说新桥秋天通车。"),
    "N-BUZZ-01": ("Attention is asserted, not shown.", "Say who reacted and how.", "引发了热议。", "两天里有四十人来信。"),
    "N-NOTE-01": ("The writer comments on the importance of the next sentence.", "Write the next sentence.", "值得注意的是，秤不准。", "秤不准。"),
    "O-STK-01": ("Adverbs of zeal are counted for density only.", "Say what will be done, by whom and when.", "切实做好防汛。", "三月底前备齐沙袋。"),
    "O-TAIL-01": ("The ending belongs to a speech, not to a document.", "End with the date of entry into force or the contact.", "相信在大家的共同努力下，明天会更好。", "本办法自五月一日起施行。"),
    "O-EXCL-01": ("Official prose does not exclaim.", "Use a full stop.", "抓紧落实！", "月底前落实。"),
    "D-STKD-01": ("Adverbs of zeal are denser than in most documents.", "Cut those without a measure behind them.", "", ""),
    "T-VOICE-01": ("Consolation is offered that was not asked for.", "Keep the fact.", "睡不着，没关系。", "又是三点没睡。"),
    "T-VOICE-02": ("The second half turns a thing into a symbol.", "Keep the thing.", "一盏灯，就是最好的礼物。", "巷口有一盏灯。"),
    "T-VOICE-03": ("An excuse is made by denying a fault.", "Say what happened.", "这不是态度问题。", "日志没存上。"),
    "T-VOICE-04": ("A gain is promised without a measure.", "Give the measure or cut it.", "效率翻倍。", "一小时能录三十条。"),
    "T-VOICE-05": ("Advice on living closes the line.", "Leave the reader's sleep alone.", "忙完了，早点睡。", "忙完了。"),
    "T-VOICE-06": ("Flattery by comparison.", "Say what was done well.", "太阳还没你起得早。", "五点半就到了。"),
    "T-VOICE-07": ("The line addresses a reader framed by a mood.", "Start with the act.", "深夜的你，还在改稿。", "还在改稿。"),
    "T-VOICE-08": ("A private matter is made mankind's.", "Keep its size.", "打工人的至暗时刻。", "电梯停了两次。"),
    "T-VOICE-09": ("An aside pretends to know the reader.", "Cut it.", "你不是说过要来吗。", "（删去）"),
    "T-VOICE-10": ("A slogan informs nobody.", "Say what comes next.", "加油，稳住！", "还差两页。"),
    "T-VOICE-11": ("The summing-up word is followed by no sum.", "Drop the word.", "综上所述，路还长。", "路还长。"),
    "T-VOICE-12": ("A jingle trades sense for rhythm.", "Say it flat.", "字没写完，人先崩溃。", "字没写完。"),
    "T-MANUAL-01": ("The line speaks as a machine describing itself.", "Say what the reader gets.", "系统会自动匹配内容。", "打开就能看到三篇。"),
    "T-MANUAL-02": ("The line lists gestures of a manual.", "Leave the gestures to the help page.", "点击按钮选择文件。", "选一份稿子。"),
    "T-MANUAL-03": ("A part of the interface is named as if it were a place.", "Name what is done there.", "左边是批注台", "左边写批注"),
    "T-DASH-01": ("Dashes are frequent for a personal text.", "Use full stops.", "", ""),
    "R-ANALYT-01": ("A critic's label replaces what was on the screen.", "Describe the shot or the scene.", "镜头语言很克制。", "镜头一直停在门口。"),
    "R-RECAP-01": ("The plot is told to readers who want a judgement.", "Give the judgement, with one scene for proof.", "影片讲述了一家三代。", "三代人那顿饭最好。"),
}
