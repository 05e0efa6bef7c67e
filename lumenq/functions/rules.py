"""Word lists of the question rules, and the classifiers they make.

Two classifiers exist, with lists and precedence of their own: the benchmark's
(numerical, comparison, why_how, methodology) and the application's (numerical,
comparison, methodology, why_how). Both default to factual.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lumenq.functions.text import words_pattern

_ZH_NUMBERS = "提升 百分比 比例 召回率 精确率 准确率 分数 几个 多少".split()
_ZH_COMPARE = "谁 哪个 更差 更好 表现 基线 超过 劣于 优于 差异 区别 不同 相比 对比 比较".split()
_ZH_METHOD = "注意力 参数 微调 预训练 目标函数 损失 嵌入 解码器 编码器 训练 架构".split()
_ZH_SYNTHESIS = "劣势 优势 解释 为何 为什么 局限 贡献 主要 整体 概括 总结".split()

_METRICS = ["accuracy", "bleu", "f1", "how many", "number of", "percent", "precision", "ratio", "recall", "rouge", "score", "size of"]

BENCH_RULES: list[tuple[str, str]] = [
    ("numerical", words_pattern(_METRICS, _ZH_NUMBERS)),
    ("comparison", words_pattern(["against", "baseline", r"better than", r"compar\w*", r"differ\w*", "outperform", "versus", r"vs\.?", "worse than"], _ZH_COMPARE)),
    ("why_how", r"(?i)(?:^\s*(?:how|why)\b)|怎么|如何|为何|为什么"),
    ("methodology", words_pattern(["architect", "attention", "decoder", "embed", "encoder", r"fine.?tun", "layer", "loss", "objective", "parameter", "pretraining", r"train(?:ing)?"], _ZH_METHOD)),
]

APP_RULES: list[tuple[str, str]] = [
    (
        "numerical",
        words_pattern(
            [*_METRICS, "batch size", "dataset size", "dropout rate", "error rate", r"experimental results?", "how much", "improvement", r"key results?", "latency", "learning rate", r"main results?",
             "memory usage", "percentage", r"performance results?", "perplexity", "throughput", "training time", "win rate"],
            _ZH_NUMBERS,
        ),
    ),
    (
        "comparison",
        words_pattern(
            ["against", "better than", r"between .+? and .+?", r"compar\w*", r"differ\w*", r"is .+? and .+? better", "one side", "outperform", "over the other", "performs better",
             r"strengths? and weaknesses?", r"trade[- ]?off", "versus", r"vs\.?", "worse than"],
            _ZH_COMPARE,
        ),
    ),
    (
        "methodology",
        words_pattern(
            ["architect", "attention layer", "beam search", r"components? are used", "decoder", r"embed(?:ding)?", "encoder", r"feed[- ]?forward network", r"fine.?tun", r"fine[- ]?tuning", "implementation details",
             "implemented", "inference algorithm", "layer", "loss function", "masking strategy", "method architecture", "model architecture", "normalization layer", "objective", "optimization setup", "parameter",
             "positional encoding", "preprocessing pipeline", "pretraining", "residual connection", r"role does.+play", "step by step", "tokenization method", r"train(?:ing)? objective"],
            _ZH_METHOD,
        ),
    ),
    (
        "why_how",
        words_pattern(
            ["advantage", "central claim", "conclusion", "contribution", "core contribution", "design rationale", "discussion", "error analysis", "evidence supports", "explain", "failure mode", "future work",
             "limitation", "main contribution", "main finding", "main idea", "motivation", "overall approach", "paper is about", "plain terms", "problem the paper solves", "research problem", "significance",
             r"summari[sz]e", "summary", "why"],
            _ZH_SYNTHESIS,
        ),
    ),
]

_ZH_YES_NO = "会不会 有没有 能否 是不是 是否".split()
YES_NO = r"(?i)^\s*(?:" + "|".join("are can could did do does has have is was were will would".split()) + r")\b|" + "|".join(_ZH_YES_NO)
_THAN = ["better than", r"between \S+ and", r"compared? to", "difference between", "higher than", "less than", "lower than", "more than", "versus", r"vs\.?", "worse than"]
CROSS_TABLE_APP = words_pattern([*_THAN, "outperform"])
CROSS_TABLE = words_pattern([*_THAN, r"outperform\w*"])
CALCULATION = words_pattern(
    ["average", "best", "decrease", "difference", "exceed", "gap", "higher", "highest", "improv", "increase", "largest", "less", "lower", "lowest", r"max(?:imum)?", "mean", r"min(?:imum)?", "more", "smallest", "surpass", "worst"],
    "超过 更低 更高 减少 增加 提升 差距 平均 最小 最大 最差 最好 最低 最高".split(),
)
SYNTHESIS = words_pattern(["advantage", "contribution", "disadvantage", "explain", "how", "limitation", "main idea", "motivat", "overall", "summarize", "summary", "why"], [*_ZH_SYNTHESIS, "如何"])
FIGURE = words_pattern(["chart", "diagram", r"fig\.?", "figure", "plot"], ["图"])
TABLE = words_pattern(["accuracy", "bleu", r"experimental results?", "f1", r"key results?", r"main results?", "performance", "precision", "recall", "result", "results", "rouge", "score", "table"], "表现 结果 召回率 精确率 准确率 分数 表".split())
CONNECTIVE = words_pattern(["across", "and", "both", "compare", "difference", "how", "or", r"trade[- ]?off", "why"])
METHOD_SIGNAL = words_pattern(["architect", "attention", "decoder", "encoder", "loss", "method", "train"])
METHOD_SECTION = words_pattern(["approach", "architect", "experiment", "implement", "method", "model", "setup", "train"])
SYNTHESIS_PHRASES = ["contribution", "limitation", "main idea", "motivation", "overall", "summarize", "summary", "why it works"]
BOUNDARY_WORDS = ["above", "below", "following", "next", "previous", "these", "this section"]

HIGH = words_pattern(["best", "highest", "largest", r"max(?:imum)?", "top"], "最大 最好 最高".split())
LOW = words_pattern(["lowest", r"min(?:imum)?", "smallest", "worst"], "最小 最差 最低".split())
AVERAGE = words_pattern(["average", "mean"], ["平均"])
DIFFERENCE = words_pattern(["decrease", "delta", "difference", "gap", "higher", r"improv(?:e|ement)?", "increase", "lower"], "低多少 高多少 减少 增加 提升 差距 差值".split())

HINTS = {"numerical": "hint.numerical", "why_how": "hint.why_how"}
TYPES = ["comparison", "factual", "methodology", "numerical", "why_how"]


def classify(question: Column, rules: list[tuple[str, str]] = APP_RULES) -> Column:
    """The first rule whose pattern is found, else factual; null questions are factual."""
    out = F.when(question.rlike(rules[0][1]), rules[0][0])
    for label, pattern in rules[1:]:
        out = out.when(question.rlike(pattern), label)
    return out.otherwise("factual")


def found(question: Column, pattern: str) -> Column:
    return F.coalesce(question.rlike(pattern), F.lit(False))


def hint(query_type: Column) -> Column:
    return F.create_map(*[F.lit(x) for kv in sorted(HINTS.items()) for x in kv])[query_type]


def contains_any(c: Column, phrases: list[str]) -> Column:
    """Whether the lower-cased text holds one of the phrases anywhere."""
    low = F.coalesce(F.lower(c), F.lit(""))
    out = F.lit(False)
    for p in phrases:
        out = out | low.contains(p)
    return out
