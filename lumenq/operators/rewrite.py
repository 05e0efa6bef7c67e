"""Search variants of a question, and its parts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lumenq.functions.rules import SYNTHESIS_PHRASES, contains_any
from lumenq.functions.text import first_seen, strip

#: What is added to the question for each type; those under "" stand alone.
TAILS: dict[str, list[tuple[bool, str]]] = {
    "comparison": [(True, "{entities} compare versus baseline difference performance results"), (True, "advantage disadvantage improvement ablation evaluation")],
    "methodology": [(True, "method architecture training objective loss implementation"), (True, "model encoder decoder layer attention algorithm")],
    "numerical": [(True, "table results metrics score accuracy f1 percentage number value"), (True, "highest lowest comparison result dataset model")],
    "why_how": [
        (True, "motivation reason explanation contribution limitation evidence"), (True, "method result analysis discussion finding"),
        (False, "proposed method main contribution abstract introduction conclusion"), (False, "this work proposes model architecture self-attention results"),
    ],
}
NUMERIC_TAIL = "table results metrics score accuracy f1 number value"
_EMPTY = "array<string>"


def _texts(values: Column) -> Column:
    return F.coalesce(F.filter(F.transform(values, strip), lambda v: v.isNotNull() & (v != "")), F.array().cast(_EMPTY))


def variants(question: Column, query_type: Column, rewrites: Column, hyde: Column, entities: Column) -> Column:
    """The question first; then the planner's rewrites and passage, or, without those, the type's templates. Repeats go, whatever their case and spacing."""
    own = F.concat(_texts(rewrites), _texts(F.array(hyde)))
    joined = F.array_join(F.coalesce(entities, F.array().cast(_EMPTY)), " ")

    def tails(kind: str) -> Column:
        out = []
        for added, tail in TAILS[kind]:
            if not added:
                out.append(F.lit(tail))
            elif tail.startswith("{entities}"):
                out.append(F.concat(question, F.lit(" "), joined, F.lit(tail[len("{entities}") :])))
            else:
                out.append(F.concat(question, F.lit(" " + tail)))
        return F.array(*out)

    wide = (query_type == "why_how") | contains_any(question, SYNTHESIS_PHRASES)
    made = F.when(query_type == "numerical", tails("numerical")).when(query_type == "comparison", tails("comparison")).when(wide, tails("why_how")).when(query_type == "methodology", tails("methodology")).otherwise(F.array().cast(_EMPTY))
    return first_seen(F.concat(F.array(question), F.when(F.size(own) > 0, own).otherwise(made)))


def of_plan(question: Column, plan: Column) -> Column:
    return variants(question, plan["query_type"], plan["rewrite_queries"], plan["hyde_query"], plan["comparison_entities"])


def decomposed(question: Column, plan: Column) -> Column:
    """Up to six subqueries: the sides of a comparison, the parts between connectives, and the type's extras."""
    parts = F.split(question, r"(?i)\b(?: (?:and|compared to|compared with|difference between|or|versus|vs\.?) )\b")
    parts = F.filter(F.transform(parts, lambda p: strip(F.regexp_replace(p, r"^[^\p{L}\p{N}_]+|[^\p{L}\p{N}_]+$", ""))), lambda p: (F.length(p) >= 3) & (F.length(p) <= 120))
    kind = plan["query_type"]
    extra = F.when(kind == "numerical", F.array(F.concat(question, F.lit(" exact number")), F.concat(question, F.lit(" table")))).when(kind.isin("comparison", "why_how", "methodology"), F.slice(of_plan(question, plan), 2, 3)).otherwise(F.array().cast(_EMPTY))
    return F.slice(first_seen(F.concat(F.slice(_texts(plan["comparison_entities"]), 1, 4), parts, extra)), 1, 6)
