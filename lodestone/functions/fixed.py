"""Patterns, word lists and weights that results depend on, as given by the data model."""

# fixed values: typographic replacements
LIGATURES = {"ﬀ": "ff", "ﬁ": "fi", "ﬂ": "fl", "ﬃ": "ffi", "ﬄ": "ffl", "ﬅ": "st", "ﬆ": "st"}
DASHES = "‐‑‒–—−"
SOFT_HYPHEN = "­"
HIDDEN_EMAIL, HIDDEN = "[邮箱已隐藏]", "[已隐藏]"
# fixed values: labels whose values are masked
MASKED_LABELS = ["姓\\s*名|姓名", "学\\s*号|学号", "电子邮件|邮箱"]
# a text without any of these has no such label
LABEL_STARTS = ["姓", "学", "电子邮件", "邮箱"]
# fixed values: markers of a document's structure and their weights
STRONG_MARKERS = ["abstract", "introduction", "conclusion", "in this paper", "in this work", "we propose", "we present", "we introduce", "we show", "本文围绕", "摘要", "结论", "研究认为"]
MEDIUM_MARKERS = ["state-of-the-art", "architecture", "model", "training", "method", "experiment", "evaluation", "dataset", "benchmark", "result", "实验", "模型", "方法", "评测", "数据", "结果"]
# fixed values: front matter
FRONT_KEEP = ["abstract", "introduction", "we propose", "in this work"]
FRONT_NOISE = ["provided proper attribution", "hereby grants permission", "journalistic or scholarly works", "work performed while at", "conference on neural information processing systems", "arxiv:"]
FRONT_LABELS = ["论文题目", "题目", "作者", "单位", "学院", "学校", "专业", "班级", "姓名", "学号", "指导教师", "完成日期", "日期", "关键词", "关键字"]
BODY_MARKERS = ["本文围绕", "本文旨在", "本文提出", "本研究", "研究认为", "in this paper", "in this work"]
# fixed values: words that aren't search tokens
TOKEN_BLOCKED = ["这个", "那个", "论文", "文档", "报告", "内容", "主要", "一下", "请问"]
# fixed values: questions
QUESTION_STOP = ["这篇论文", "这份文档", "这个文档", "这篇文档", "这份报告", "请你", "请问", "给我", "一下", "什么", "哪些", "为什么", "怎么样", "如何", "是否", "能否", "可以"]
QUESTION_TERMS = ["参考文献", "引用文献", "结论", "结果", "方法", "研究方法", "实验方法", "局限", "不足", "风险", "贡献", "创新", "数据", "样本", "问卷", "访谈", "实验", "模型", "算法", "公式", "表格", "作者", "标题", "主题", "目的"]
QUESTION_BLOCKED = ["论文", "文档", "报告", "内容", "主要", "一个", "这个", "那个"]
PHRASE_STOP = ["what", "which", "where", "when", "how", "does", "did", "is", "are", "was", "were", "the", "this", "that", "paper", "document", "report", "reported", "describe", "describes", "claim", "claims", "about", "with", "from", "compared", "previous", "use", "uses", "using"]
MEANINGLESS_CHARS = "这篇份个的了呢吗啊和与及或是有在中里上下一些哪些什么怎么如何请问"
# fixed values: reliability weights
RELIABILITY = {"课程报告": 8, "实验报告": 7, "随机生成": 8, "论文样稿": 8, "毕业论文": 6, "学位论文": 6, "摘要": 3, "参考文献": 4, "数据来源": 4, "实证数据": 4, "未来研究": 4, "文献分析": 3, "情境推演": 3, "机制建构": 3, "一致性检验": 3, "后评价": 3, "结论": 2, "结果": 2, "计算": 2, "公式": 2, "分析": 2, "评价": 2, "完成日期": 2, "测试": 2, "局限": 2, "不足": 2}
# fixed values: headings of sections
NUMBERING = r"(?:(?:第?[一二三四五六七八九十]+[章节、.．]|\d+(?:\.\d+)*[.、．]?)\s*)?"
SECTIONS = {
    "Abstract": "abstract|摘要",
    "Introduction": "introduction|引言|绪论",
    "Methods": "methods?|methodology|方法|实验方法|研究方法",
    "Results": "results?|结果|实验结果|研究结果",
    "Discussion": "discussion|讨论|分析与讨论",
    "Limitations": "limitations?|研究局限|局限性|局限与不足|研究不足|不足与展望|不足",
    "FutureWork": r"future\s+work|future\s+research|未来研究|后续研究|研究展望|展望",
    "Conclusion": "conclusions?|结论与展望|结论|总结",
    "References": "references|参考文献",
}
TABLE_CAPTION = r"^(?:table|tab\.|表)\s*\d+|^表[一二三四五六七八九十]+"
TABLE_CONTEXT = r"\b(table|tab\.)\s*\d+|表\s*[一二三四五六七八九十\d]+|注[:：]|数据来源|资料来源|source"
# fixed values: what a question asks for
ASKS = {
    "visual": ["图片", "截图", "运行截图", "图表", "图中", "图里", "图上", "图示", "架构图", "示意图", "视觉证据", "图片证据", "看图", "figure", "fig.", "chart", "diagram", "screenshot", "visual evidence", "image evidence", "what does the image", "what does the figure", "shown in the image", "shown in the figure", "in the image", "in the figure", "from the image", "from the figure"],
    "paired": ["图像-文本", "图像文本", "图像/文本", "图像与文本", "图像和文本", "图文", "image-text", "image text", "image/text", "image and text"],
    "paired_data": ["数据", "数据集", "规模", "训练", "预训练", "对", "dataset", "datasets", "data", "training", "pretraining", "pre-training", "pairs", "pair"],
    "weak_visual": ["图像", "视觉", "image", "visual"],
    "table": ["评分表", "实验评分", "分数构成", "分数", "总分", "表格中", "表中", "结构化数据", "数据是多少", "指标", "数值", "公式", "计算"],
    "reference": ["参考文献", "引用文献", "引用了哪些", "参考了哪些", "用了哪些文献", "用了哪些参考", "文献列表", "参考列表", "references", "bibliography"],
    "reference_verb": ["哪些", "列出", "引用", "参考", "出处", "来源"],
    "compare": ["对比", "比较", "不同点", "差异", "区别", "有什么不同", "哪里不同", "compare", "comparison", "different", "differences", "versus", " vs "],
    "field_broad": ["分析", "解释", "意思", "含义", "评价", "判断", "为什么", "有必要", "必要吗", "需要吗", "该不该", "干扰", "怎么", "如何", "可靠", "局限", "不足", "贡献", "方法", "结论", "风险", "治理", "支撑", "匹配", "相符", "跑题", "概括", "总结", "摘要一下"],
    "field_lookup": ["是什么", "有哪些", "哪些", "列出", "提取", "写出", "给我", "告诉我", "是多少", "是谁", "字段", "部分", "内容", "keyword"],
    "meta": ["你是谁", "怎么使用", "有哪些功能", "如何上传", "支持什么模型"],
    "overview": ["概括", "总结", "讲了什么", "讲啥", "写了啥", "写的啥", "说了啥", "主要内容", "通俗语言", "大意", "一句话"],
    "overview_action": ["介绍", "说说", "讲讲", "讲一下", "说一下", "看一下", "简单说", "简单讲", "大概", "概括", "总结", "讲了什么", "写了什么", "写了啥", "是干嘛", "做什么", "干什么"],
    "overview_scope": ["文章", "论文", "文档", "报告", "材料", "这篇", "这份", "全文", "内容", "实验", "章节", "部分"],
    "document_wide": ["概括", "总结", "讲了什么", "讲啥", "讲了啥", "写了啥", "写的啥", "说了啥", "大概讲", "大概说", "主要内容", "主要写", "通俗语言", "大意", "一句话", "发现", "重点", "核心", "结论", "贡献", "方法", "局限", "不足", "目的", "主题", "能学到", "学到什么", "收获", "启发"],
    "opening": ["概括", "总结", "讲了什么", "讲啥", "讲了啥", "写了啥", "写的啥", "说了啥", "主要内容", "大意", "一句话", "目的", "主题", "能学到", "学到什么", "收获", "启发"],
    "experiment": ["内容", "目的", "要求", "步骤", "过程", "任务", "介绍", "说说", "讲讲", "概括", "总结", "做什么", "干什么", "是干嘛"],
    "topics": ["选题", "多篇", "多份", "几篇", "这些文献", "全部文献", "所有文献", "同时纳入", "一起分析", "综合", "归纳", "综述", "文献综述", "研究现状", "共同", "关系", "关联", "互相", "异同", "脉络"],
    "metric": ["结果", "result", "results", "table", "表格", "指标", "metric", "score", "accuracy", "error", "benchmark"],
    "dataset": ["数据集", "训练数据", "数据规模", "规模", "dataset", "corpus", "training set", "data scale", "samples", "多少", "构建"],
    "pretraining_objective": ["预训练目标", "pre-training objective", "pretraining objective"],
    "pretraining": ["预训练", "pre-training", "pretraining"],
    "objective": ["目标", "objective", "goal", "loss", "task"],
    "function": ["核心功能", "功能集合", "功能", "functions", "function", "core functions", "core function"],
    "framework": ["framework", "框架", "model", "system", "method"],
    "component": ["作用", "角色", "role", "component", "stage"],
    "trustworthy": ["可信", "trustworthy"],
    "characteristic": ["特征", "特点", "characteristic", "characteristics"],
    "mechanism": ["how", "why", "pursue", "achieve", "improve", "approach", "method", "mechanism", "compare", "如何", "怎么", "怎样", "机制", "方法", "对比"],
    "efficiency": ["efficiency", "efficient", "resource", "memory", "parameter", "parameters", "compute", "storage", "throughput", "latency", "speedup", "faster", "smaller", "cost"],
    "idea": ["main idea", "core idea", "method idea", "adaptation idea", "approach", "mechanism"],
    "adaptation": ["adaptation", "fine-tuning", "pre-trained", "pretrained", "weights", "rank", "matrix", "matrices", "parameter"],
    "factor_topic": ["design", "training", "factor", "factors", "ablation", "component", "components"],
    "factor_ask": ["important", "identify", "affect", "effect", "learned representation", "representation"],
    "code": ["代码", "源码", "函数", "类", "实现细节", "怎么实现", "程序", "写法"],
    "submission": ["提交", "交什么", "作业", "思考题", "选做", "评分", "交报告", "交代码"],
}
# fixed values: fields that a question may ask for, and their names in questions
FIELD_ALIASES = {"keywords": ["关键词", "关键字", "keywords", "keyword", "key words"], "abstract": ["摘要", "abstract"], "authors": ["作者"], "affiliation": ["作者单位", "单位", "机构"], "date": ["完成日期", "日期", "时间"], "title": ["标题", "题目"]}
# fixed values: how each intent is retrieved
STRATEGIES = {"reference_question": "reference_section", "field_lookup_question": "field_lookup", "compare_question": "comparison_overview", "document_wide_question": "document_overview", "meta_question": "no_retrieval", "specific_question": "vector_similarity"}
# fixed values: kinds of noise
METADATA_LABEL = "(关键词|关键字|作者|单位|作者单位|机构|日期|完成日期)\\s*[:：]"
SUBMISSION_NOISE = ["实验提交", "提交代码", "提交报告", "思考题", "选做", "作业提交", "评分标准", "可添加公式"]
CODE_MARKERS = ["function ", "const ", "let ", "var ", "=>", "addEventListener", "querySelector", "return ", "class ", "</", "{", "}", ";"]
CODE_LINE = r"function\s+\w+|const\s+\w+|let\s+\w+|var\s+\w+|=>|[{};]{2,}|</?\w+"
# a line without any of these is no line of code
CODE_STARTS = ["function", "const", "let", "var", "=>", "{", "}", ";", "<"]
FRAMEWORK_WORDS = ["function", "functions", "core", "component", "components", "capability", "capabilities", "stage", "process", "role", "policy", "strategy"]
# fixed values: words of a framework's functions, and what raises a chunk that has two of them
FUNCTION_WORDS = ["function", "functions", "core", "component", "components", "capability", "capabilities", "stage", "stages", "process", "processes", "role", "roles", "policy", "strategy", "outcome", "outcomes"]
FUNCTION_MARKERS = ["core", "function", "functions", "component", "components", "categories"]
COMPOSED_OF = ["composed of", "consists of", "organized into", "functions organize"]
# fixed values: what says that an answer refuses, and that a case expects it
REFUSAL_SIGNALS = ["证据不足", "无法证明", "不能证明", "没有证据", "未找到", "不支持", "不能得出", "无法判断", "not enough evidence", "cannot determine", "does not support", "no evidence"]
REFUSAL_EXPECTED = ["证据不足", "无法证明", "没有证据", "无关结论", "unsupported", "not enough evidence"]
# fixed values: what raises a score table and a screenshot
SCORE_TABLES = ["实验分数构成", "实验过程", "实验结果", "实验总分"]
SCREENS = ["运行结果", "截图", "Visual Studio", "开放", "回显"]
# fixed values: titles of conversations
TITLE_LENGTH, UNTITLED = 40, "新的论文对话"
# fixed values: words that no quote is chosen by
QUOTE_STOP = ["what", "which", "where", "when", "how", "does", "did", "is", "are", "was", "were", "the", "this", "that", "for", "and", "with", "from", "reported", "report"]
# fixed values: what tells a table's header, what raises a sentence or a table row in a quote, and a row as a unit
HEADER_WORDS = ["metric", "score", "accuracy", "error", "model", "method", "dataset", "指标", "结果"]
QUOTE_METHOD = ["we propose", "we present", "we show", "result", "dataset", "method"]
QUOTE_METRICS = ["accuracy", "error", "score", "metric", "result", "auc", "f1", "%", "结果", "指标"]
ROW_METRICS = ["accuracy", "error", "score", "metric", "result", "auc", "f1", "memory", "parameter", "%"]
# fixed values: marks of a mechanism: any of the words of each group must be there, and what that adds; .32 at most in all
MECHANISMS = [
    ([["we propose", "propose", "proposed", "method", "approach"]], 0.06),
    ([["using", "by ", "inject", "injected", "scale", "scaling"]], 0.04),
    ([["compound"], ["coefficient", "scaling"]], 0.12),
    ([["width"], ["depth"], ["resolution"]], 0.1),
    ([["rank decomposition", "low-rank", "low rank"]], 0.12),
    ([["freeze", "freezes", "frozen"], ["weight"]], 0.1),
    ([["trainable"], ["parameter", "matrix", "matrices"]], 0.08),
    ([["efficiency", "efficient", "memory", "flops", "latency", "faster", "smaller"]], 0.05),
]
UNIT_SECTIONS = ["result", "experiment", "abstract", "conclusion"]
