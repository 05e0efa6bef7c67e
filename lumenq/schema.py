"""Fixed schemas of the engine's tables."""

from __future__ import annotations

from pyspark.sql import types as T

_S, _L, _I, _D, _B = T.StringType(), T.LongType(), T.IntegerType(), T.DoubleType(), T.BooleanType()


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(k, v) for k, v in fields.items()])


ANSWER = _struct(unanswerable=_B, extractive_spans=T.ArrayType(_S), yes_no=_B, free_form_answer=_S, evidence=T.ArrayType(_S))
QA = _struct(question=_S, question_id=_S, nlp_background=_S, topic_background=_S, answers=T.ArrayType(_struct(answer=ANSWER)))
PAPER = _struct(title=_S, abstract=_S, full_text=T.ArrayType(_struct(section_name=_S, paragraphs=T.ArrayType(_S))), qas=T.ArrayType(QA))
PAPERS = T.MapType(_S, PAPER)

CHUNK = _struct(
    chunk_id=_S, original_chunk_id=_S, paper_id=_S, paper_title=_S, ordinal=_L, section=_S, sec_idx=_I, text=_S,
    chunk_type=_S, index_text=_S, caption=_S, table_columns=T.ArrayType(_S), table_rows=T.ArrayType(T.ArrayType(_S)),
)
RANKED = _struct(qid=_S, chunk_id=_S, rank=_L, score=_D, score_kind=_S)
PLAN = _struct(
    query_type=_S, cross_table=_B, is_yes_no=_B, evidence_need=_S, source_preference=T.ArrayType(_S), answer_style=_S,
    confidence_checks=T.ArrayType(_S), comparison_entities=T.ArrayType(_S), needs_calculation=_B, classifier=_S, route_level=_S,
    route_confidence=_D, complexity_score=_D, retrieval_strategy=_S, rewrite_queries=T.ArrayType(_S), hyde_query=_S,
)
FACT = _struct(source_rank=_I, value=_D, raw_value=_S, metric=_S, row_label=_S, caption=_S, chunk_id=_S)
JUDGEMENT = _struct(score=_I, verdict=_S, missing_facts=T.ArrayType(_S), reason=_S)
FEEDBACK = _struct(ts=T.TimestampType(), session_id=_S, question=_S, helpful=_B, failure_type=_S, mode=_S, query_type=_S, answer=_S, retrieved_chunk_ids=T.ArrayType(_S))
