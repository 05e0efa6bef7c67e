"""A bounded, tool-using retrieval loop, as a state machine, and over batches of questions.

A policy sees the question, its profile and the last observation, and names the
next tool with arguments, or none to stop. One call runs in each round. Offline
the policy is a fixed rule; tests use scripts. Answers come from an
``AnswerGenerator`` when there is evidence; ``prefer_verified`` takes a verified
or final answer first instead.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lumenq.functions.rules import BOUNDARY_WORDS
from lumenq.functions.text import NUMBER, PLAIN_NUMBER, STOP_WORDS
from lumenq.operators import bm25
from lumenq.operators.rerank import listed
from lumenq.operators.rewrite import NUMERIC_TAIL

CAP, MAX_STEPS, NEIGHBOUR_BUDGET, FAILURES = 16, 7, 2, 2
TABLES = ("table", "merged_tables")
BASE_TOOLS = ["rewrite_query", "decompose_question", "retrieve_evidence", "retrieve_fusion", "retrieve_numeric_or_table"]
Row = dict[str, Any]
_TEXT, _COUNT = {"type": "string"}, {"type": "integer", "minimum": 1}
#: What each tool is for, its arguments and those that it needs.
TOOLS: dict[str, tuple[str, dict, list[str]]] = {
    "rewrite_query": ("Other wordings of the question, or of a part of it.", {"focus": _TEXT}, []),
    "decompose_question": ("Subquestions that together answer the question.", {}, []),
    "retrieve_evidence": ("The chunks that match one query best.", {"query": _TEXT, "top_k": _COUNT}, ["query"]),
    "retrieve_fusion": ("Chunks for several wordings of a query, united.", {"query": _TEXT, "top_k": _COUNT}, ["query"]),
    "retrieve_numeric_or_table": ("Chunks with tables or numbers first.", {"query": _TEXT, "top_k": _COUNT}, ["query"]),
    "list_neighbor_chunks": ("What stands next to a chunk in its document.", {"chunk_id": _TEXT}, ["chunk_id"]),
    "extract_table_data": ("Columns and rows of the tables found so far.", {"chunk_id": _TEXT}, []),
    "inspect_context": ("Whether the evidence suffices, and its gaps.", {}, []),
    "verify_answer_support": ("Which claims of a draft the evidence supports.", {"candidate_answer": _TEXT}, ["candidate_answer"]),
    "finish": ("Ends the search, with an answer or without.", {"final_answer": _TEXT}, []),
}


def schemas(names: list[str] | None = None) -> list[dict]:
    """The tools as JSON schemas of functions, in the given order; unknown names are left out. All take a reason."""
    out = []
    for name in TOOLS if names is None else [n for n in names if n in TOOLS]:
        about, properties, required = TOOLS[name]
        made = {"type": "object", "properties": {**properties, "reason": _TEXT}, "required": required, "additionalProperties": False}
        out.append({"type": "function", "function": {"name": name, "description": about, "parameters": made}})
    return out


@dataclass
class State:
    question: str
    plan: dict = field(default_factory=dict)
    profile: dict = field(default_factory=dict)
    evidence: list[Row] = field(default_factory=list)
    steps: list[dict] = field(default_factory=list)
    near: set = field(default_factory=set)
    expansions: int = 0
    attempts: int = 0
    failures: int = 0
    stop: str | None = None
    final: str = ""
    verified: str = ""
    careful: str = ""

    def ids(self) -> list[str]:
        return [r["chunk_id"] for r in self.evidence]

    def _fresh(self, rows: list[Row]) -> list[Row]:
        seen, out = set(self.ids()), []
        for r in rows:
            if r.get("chunk_id") and r["chunk_id"] not in seen:
                seen.add(r["chunk_id"])
                out.append(r)
        return out

    def add(self, rows: list[Row], front: bool = False) -> list[str]:
        """Chunks not there yet go to the end, or the front; 16 stay."""
        new = self._fresh(rows)
        self.evidence = ([*new, *self.evidence] if front else [*self.evidence, *new])[:CAP]
        return [r["chunk_id"] for r in new if r["chunk_id"] in set(self.ids())]

    def add_near(self, anchor: str, rows: list[Row]) -> list[str]:
        """Neighbours go right behind their anchor, or to the end without it."""
        new, ids = self._fresh(rows), self.ids()
        at = ids.index(anchor) + 1 if anchor in ids else len(ids)
        self.evidence = [*self.evidence[:at], *new, *self.evidence[at:]][:CAP]
        return [r["chunk_id"] for r in new if r["chunk_id"] in set(self.ids())]

    def status(self) -> dict:
        return {
            "evidence_count": len(self.evidence), "chunk_ids": self.ids(), "sections": sorted({r.get("section") for r in self.evidence if r.get("section")})[:8],
            "table_chunk_ids": [r["chunk_id"] for r in self.evidence if r.get("chunk_type") in TABLES], "numeric_chunk_ids": [r["chunk_id"] for r in self.evidence if re.search(r"\d", r.get("text") or "")][:8],
            "neighbor_expansions_used": self.expansions, "neighbor_candidate_ids": sorted(self.near),
        }


def united(groups: list[list[Row]]) -> list[Row]:
    seen, out = set(), []
    for g in groups:
        for r in g:
            if r.get("chunk_id") and r["chunk_id"] not in seen:
                seen.add(r["chunk_id"])
                out.append(r)
    return out


def words(text: str) -> set[str]:
    return set(re.findall(r"[a-z][a-z0-9_-]{2,}", (text or "").lower())) - set(STOP_WORDS)


def claims_of(answer: str) -> list[str]:
    parts = re.split(r"(?<=[.!?])\s+|;\s+|\n+", re.sub(r"\[[0-9,\s]+\]", "", answer or ""))
    return [c for c in (" ".join(p.split()).strip(" -") for p in parts) if len(c) >= 12][:12]


def check_claim(claim: str, evidence: list[Row]) -> dict:
    mine, nums = words(claim), re.findall(PLAIN_NUMBER, claim)
    best = {"chunk_id": "", "overlap": 0, "tokens": 0.0, "numbers": 0.0 if nums else 1.0}
    for r in evidence:
        low = (r.get("text") or "").lower()
        n = len(mine & words(low))
        t, k = n / max(1, len(mine)), sum(x.lower() in low for x in nums) / len(nums) if nums else 1.0
        if 0.75 * t + 0.25 * k > 0.75 * best["tokens"] + 0.25 * best["numbers"]:
            best = {"chunk_id": r["chunk_id"], "overlap": n, "tokens": round(t, 3), "numbers": round(k, 3)}
    fine = best["numbers"] >= 1.0 and (best["tokens"] >= 0.35 or (not nums and best["overlap"] >= 3))
    return {"claim": claim, "supported": fine, "best_chunk_id": best["chunk_id"], "token_support": best["tokens"], "number_support": best["numbers"]}


def available(state: State, used: bool, neighbours: bool = True) -> list[str]:
    """The tools that a policy may name now."""
    if state.failures >= FAILURES and state.evidence:
        return ["finish"]
    if not used or not state.evidence:
        return list(BASE_TOOLS)
    if state.failures:
        return [*BASE_TOOLS[2:], "verify_answer_support", "finish"]
    more = ["list_neighbor_chunks"] if neighbours and state.near and state.expansions < NEIGHBOUR_BUDGET else []
    more += ["extract_table_data"] if state.status()["table_chunk_ids"] else []
    return [*BASE_TOOLS, *more, "inspect_context", "verify_answer_support", "finish"]


def suggestions(state: State, added: list[str], rows: list[Row]) -> list[str]:
    """What a policy might do next; the question's profile says what it is after."""
    st, out = state.status(), []
    if not state.evidence:
        return [f"start_with_{state.profile.get('suggested_start', 'retrieve_evidence')}"]
    if state.profile.get("numeric_or_table") and not st["table_chunk_ids"] and not st["numeric_chunk_ids"]:
        out.append("retrieve_numeric_or_table_with_metric_terms")
    if state.profile.get("comparison") and len(st["sections"]) < 2:
        out.append("retrieve_fusion_for_more_sections")
    if added and state.expansions < NEIGHBOUR_BUDGET and any(w in (r.get("text") or "").lower() for r in rows[:3] for w in BOUNDARY_WORDS):
        out.append("list_neighbor_chunks_of_an_incomplete_one")
    return out or ["finish_if_supported_else_rewrite_query"]


def arguments(raw: Any) -> dict:
    """A call's arguments; what isn't a JSON object is empty."""
    if isinstance(raw, dict):
        return dict(raw)
    try:
        out = json.loads(raw or "{}")
    except (TypeError, ValueError):
        return {}
    return out if isinstance(out, dict) else {}


class Tools:
    def __init__(self, retrieve: Callable[[str, int], list[Row]], neighbours: Callable[[str, int], list[Row]] | None = None, variants: Callable[[str, dict], list[str]] | None = None):
        self.retrieve, self.neighbours = retrieve, neighbours
        self.variants = variants or (lambda q, plan: [q, *(plan.get("rewrite_queries") or [])])

    def run(self, name: str, s: State, args: dict) -> dict:
        tool = getattr(self, f"_{name}", None)
        if tool is None:
            return {"ok": False, "error": f"unknown tool {name}"}
        return {"agent_reason": str(args.get("reason") or ""), **tool(s, args), "evidence_status": s.status()}

    def _found(self, s: State, rows: list[Row], added: list[str], **more) -> dict:
        for r in rows[:5]:
            if any(w in (r.get("text") or "").lower() for w in BOUNDARY_WORDS):
                s.near.add(r["chunk_id"])
        return {"ok": True, "added_chunk_ids": added, "retrieved": [{"rank": i + 1, "chunk_id": r["chunk_id"], "score": round(r.get("score") or 0.0, 4), "preview": " ".join((r.get("text") or "").split())[:280]} for i, r in enumerate(rows)], "suggested_next_actions": suggestions(s, added, rows), **more}

    def many(self, queries: list[str], k: int) -> list[list[Row]]:
        return [self.retrieve(q, k) for q in queries]

    def _rewrite_query(self, s: State, a: dict) -> dict:
        return {"ok": True, "rewrites": self.variants(str(a.get("focus") or "").strip() or s.question, s.plan)}

    def _decompose_question(self, s: State, a: dict) -> dict:
        return {"ok": True, "subqueries": list(s.plan.get("subqueries") or self.variants(s.question, s.plan)[1:7])}

    def _retrieve_evidence(self, s: State, a: dict) -> dict:
        rows = self.retrieve(str(a.get("query") or s.question), int(a.get("top_k") or 5))
        return self._found(s, rows, s.add(rows))

    def _retrieve_fusion(self, s: State, a: dict) -> dict:
        k = int(a.get("top_k") or 7)
        views = self.variants(str(a.get("query") or s.question), s.plan)
        rows = united(self.many(views, max(k, 7)))[:k]
        return self._found(s, rows, s.add(rows), variants=views)

    def _retrieve_numeric_or_table(self, s: State, a: dict) -> dict:
        k = int(a.get("top_k") or 7)
        wide = f"{a.get('query') or s.question} {NUMERIC_TAIL}"
        rows = self.retrieve(wide, max(k, 7))
        first = [r for r in rows if r.get("chunk_type") in TABLES or re.search(r"\d", r.get("text") or "")]
        rows = united([first, rows])[:k]
        table = any(r.get("chunk_type") in TABLES for r in rows)
        return self._found(s, rows, s.add(rows, front=table), expanded_query=wide, prepended=table)

    def _list_neighbor_chunks(self, s: State, a: dict) -> dict:
        if self.neighbours is None:
            return {"ok": False, "error": "no neighbours here"}
        anchor = str(a.get("chunk_id") or "")
        if s.expansions >= NEIGHBOUR_BUDGET:
            return {"ok": True, "anchor_chunk_id": anchor, "added_chunk_ids": [], "note": "the budget is spent"}
        if not anchor:
            return {"ok": False, "error": "chunk_id is required"}
        added = s.add_near(anchor, self.neighbours(anchor, 1))
        s.near.discard(anchor)
        s.expansions += 1
        return {"ok": True, "anchor_chunk_id": anchor, "added_chunk_ids": added}

    def _extract_table_data(self, s: State, a: dict) -> dict:
        tables = [r for r in s.evidence if r.get("chunk_type") in TABLES and (not a.get("chunk_id") or r["chunk_id"] == a["chunk_id"])]
        if not tables:
            return {"ok": False, "error": "no table in the evidence", "tables_found": 0}
        return {"ok": True, "tables_found": len(tables), "tables": [{"chunk_id": r["chunk_id"], "columns": r.get("table_columns") or [], "rows": (r.get("table_rows") or [])[:20]} for r in tables]}

    def _inspect_context(self, s: State, a: dict) -> dict:
        st, kind = s.status(), s.plan.get("query_type", "factual")
        facts = [m for r in s.evidence for m in re.findall(NUMBER, r.get("text") or "")]
        gaps = [] if s.evidence else ["no evidence retrieved"]
        if kind == "numerical" and not facts and not st["table_chunk_ids"]:
            gaps.append("numeric/table evidence missing")
        if kind in ("comparison", "why_how", "methodology") and len(st["sections"]) < 2:
            gaps.append("multi-source evidence may be insufficient")
        return {"ok": True, "sufficient": not gaps, "gaps": gaps, "numeric_fact_count": len(facts)}

    def _finish(self, s: State, a: dict) -> dict:
        s.stop = str(a.get("reason") or "finished")
        s.final = str(a.get("final_answer") or "").strip() or s.final
        return {"ok": True, "stop": True, "reason": s.stop}

    def _verify_answer_support(self, s: State, a: dict) -> dict:
        s.attempts += 1
        draft = str(a.get("candidate_answer") or "").strip()
        checked = [check_claim(c, s.evidence) for c in claims_of(draft)]
        if not checked:
            s.failures += 1
            return {"ok": False, "error": "there is no claim to check"}
        good = [c for c in checked if c["supported"]]
        whole = len(good) == len(checked)
        text = " ".join(c["claim"].rstrip(".") + "." for c in good)
        if whole:
            s.failures, s.verified = 0, draft
        else:
            s.failures += 1
            s.careful = text or s.careful
        return {"ok": True, "claims_checked": checked, "support_coverage": round(len(good) / len(checked), 3), "supported_answer_candidate": text, "verified": whole, "failed_verifications": s.failures}


def extract_answer(question: str, evidence: list[Row], plan: dict) -> str:
    """Offline answer: the evidence's sentence that shares the most words with the question, cited."""
    best, text, at = -1, "", 0
    for i, r in enumerate(evidence, 1):
        for sent in re.split(r"(?<=[.!?])\s+", r.get("text") or ""):
            n = len(words(sent) & words(question))
            if n > best:
                best, text, at = n, sent.strip(), i
    return f"{text} [{at}]"


def rule_policy(s: State, tools: list[str], last: dict | None, profile: dict) -> list[dict]:
    """The offline policy: the retrieval that the profile suggests, an inspection, one wider retrieval if gaps are left, then the end."""
    done = [x["name"] for x in s.steps]
    if profile["suggested_start"] not in done:
        return [{"name": profile["suggested_start"], "arguments": {"query": s.question}}]
    if "inspect_context" in tools and "inspect_context" not in done:
        return [{"name": "inspect_context", "arguments": {}}]
    if last and last.get("gaps") and "retrieve_fusion" not in done:
        return [{"name": "retrieve_fusion", "arguments": {"query": s.question}}]
    return [{"name": "finish", "arguments": {"reason": "enough"}}] if "finish" in tools else []


def run(question: str, plan: dict, tools: Tools, policy: Callable[..., list[dict]] = rule_policy, top_k: int = 5, max_steps: int = MAX_STEPS, generate=extract_answer, profile: dict | None = None, prefer_verified: bool = False) -> dict:
    """The loop: answer, retrieved, trace and rounds. Only a turn's first call is executed; no call, ``finish`` or the step limit ends it."""
    profile = profile or {"suggested_start": "retrieve_evidence"}
    s = State(question, plan or {}, profile)
    used, last, rounds = False, None, []
    for step in range(1, max_steps + 1):
        names = available(s, used, tools.neighbours is not None)
        calls = policy(s, names, last, profile) or []
        record = {"round": step, "available_tools": names, "evidence_chunk_ids_before": s.ids(), "tool_results": []}
        for i, call in enumerate(calls):
            args = arguments(call.get("arguments"))
            out = tools.run(call["name"], s, args) if not i else {"ok": False, "error": "one call runs in each turn", "evidence_status": s.status()}
            used, last = True, out if not i else last
            s.steps.append({"name": call["name"], "ok": bool(out.get("ok")), "step": step})
            record["tool_results"].append({"tool_name": call["name"], "args": json.dumps(args, sort_keys=True), "output": json.dumps(out, sort_keys=True, default=str)})
        record["evidence_chunk_ids_after"] = s.ids()
        rounds.append(record)
        if not calls:
            s.steps.append({"name": "model_stop", "ok": True, "step": step})
            break
        if s.stop is not None:
            break
    else:
        s.steps.append({"name": "guardrail_pause", "ok": True, "step": max_steps})
    kept = s.evidence[:top_k]
    spare = s.final or s.verified or s.careful
    if kept and not (prefer_verified and spare):
        answer = generate(question, kept, s.plan)
    else:
        answer = spare or "The sources don't hold enough to answer."
    s.steps.append({"name": "generate", "ok": True, "step": len(rounds)})
    return {"answer": answer, "retrieved": kept, "trace": s.steps, "rounds": rounds, "attempts": s.attempts, "verified": bool(s.verified)}


def local_search(rows: list[Row]) -> Callable[[str, int], list[Row]]:
    """BM25 over a few candidate chunks, in one worker."""
    import math

    docs = [re.findall("[a-z0-9]+", (r.get("text") or "").lower()) for r in rows]
    mean = sum(map(len, docs)) / max(1, len(docs)) or 1.0
    df: dict[str, int] = {}
    for d in docs:
        for t in set(d):
            df[t] = df.get(t, 0) + 1
    idf = {t: math.log(len(docs) - n + 0.5) - math.log(n + 0.5) for t, n in df.items()}
    floor = 0.25 * sum(idf.values()) / max(1, len(idf))
    idf = {t: floor if x < 0 else x for t, x in idf.items()}

    def search(query: str, k: int) -> list[Row]:
        out = []
        for i, d in enumerate(docs):
            s = 0.0
            for t in re.findall("[a-z0-9]+", query.lower()):
                n = d.count(t)
                if n:
                    s += idf[t] * n * 2.5 / (n + 1.5 * (0.25 + 0.75 * len(d) / mean))
            out.append((-round(s, 9), i, s))
        return [{**rows[i], "score": s} for _, i, s in sorted(out)[:k]]

    return search


TRACE = "qid string, answer string, retrieved_ids array<string>, tools array<string>, n_rounds int, verified boolean, rounds string"
LOOKUPS = "qid string, kind string, key string, k int, rows string"
_PASS = TRACE + ", needs array<struct<kind: string, key: string, k: int>>"


class Missing(Exception):
    """Look-ups (kind, key, k) that aren't known yet."""

    def __init__(self, needs: list[tuple[str, str, int]]):
        super().__init__("look-ups are missing")
        self.needs = needs


class KnownTools(Tools):
    """Tools over look-ups that were made before."""

    def __init__(self, known: dict[tuple[str, str, int], list[Row]]):
        super().__init__(lambda q, k: self.many([q], k)[0], lambda c, w: self._get([("near", c, w)])[0])
        self.known = known

    def _get(self, keys: list[tuple[str, str, int]]) -> list[list[Row]]:
        gone = [x for x in keys if x not in self.known]
        if gone:
            raise Missing(gone)
        return [self.known[x] for x in keys]

    def many(self, queries: list[str], k: int) -> list[list[Row]]:
        return self._get([("search", q, k) for q in queries])


def traced(qid: str, got: dict) -> dict:
    return {"qid": qid, "answer": got["answer"], "retrieved_ids": [r["chunk_id"] for r in got["retrieved"]], "tools": [t["name"] for t in got["trace"]], "n_rounds": len(got["rounds"]), "verified": got["verified"], "rounds": json.dumps(got["rounds"], default=str)}


def _passes(policy, top_k: int, max_steps: int):
    def run_all(batches):
        for b in batches:
            out = []
            for r in b.to_dict("records"):
                known = {(x["kind"], x["key"], int(x["k"])): json.loads(x["rows"]) for x in (r["known"] if r["known"] is not None else [])}
                plan = {"query_type": r["query_type"], "rewrite_queries": list(r["rewrites"]) if r["rewrites"] is not None else []}
                try:
                    made = run(r["question"], plan, KnownTools(known), policy, top_k, max_steps, profile=json.loads(r["profile"]))
                    out.append({**traced(r["qid"], made), "needs": []})
                except Missing as e:
                    none = dict.fromkeys(("answer", "retrieved_ids", "tools", "n_rounds", "verified", "rounds"))
                    out.append({"qid": r["qid"], **none, "needs": [{"kind": a, "key": c, "k": k} for a, c, k in dict.fromkeys(e.needs)]})
            frame = pd.DataFrame(out, columns=["qid", "answer", "retrieved_ids", "tools", "n_rounds", "verified", "rounds", "needs"], dtype=object)
            yield frame.astype({"n_rounds": "Int32", "verified": "boolean"})

    return run_all


def _searched(chunks: DataFrame, index, needs: DataFrame, retrieve) -> DataFrame:
    """Look-ups by one retrieval for all questions' queries."""
    each = needs.where("kind = 'search'").withColumn("id", F.concat_ws("#", "qid", F.md5("key"), "k"))
    most = each.agg(F.max("k")).first()[0]
    row = F.struct("rank", *[c for c in ("chunk_id", "ordinal", "section", "chunk_type", "text", "score")])
    if most is None:
        return each.select("qid", "kind", "key", "k", F.lit("[]").alias("rows"))
    got = retrieve(index, each.select(F.col("id").alias("qid"), F.col("key").alias("text")), most).select(F.col("qid").alias("id"), "chunk_id", "rank", "score")
    near = got.join(each.select("id", "k"), "id").where("rank <= k").join(listed(chunks, got).select("chunk_id", "ordinal", "section", "chunk_type", "text"), "chunk_id")
    lists = near.groupBy("id").agg(F.to_json(F.array_sort(F.collect_list(row))).alias("rows"))
    return each.join(lists, "id", "left").select("qid", "kind", "key", "k", F.coalesce("rows", F.lit("[]")).alias("rows"))


def _beside(chunks: DataFrame, needs: DataFrame, paper: str) -> DataFrame:
    """Neighbours of chunks by their places in their documents."""
    each = needs.where("kind = 'near'")
    if each.isEmpty():
        return each.select("qid", "kind", "key", "k", F.lit("[]").alias("rows"))
    # places are counted in the documents that are asked for, not in all
    anchors = listed(chunks, each.select(F.col("key").alias("chunk_id"))).select(paper)
    placed = listed(chunks, anchors, paper).select("chunk_id", "ordinal", "section", "chunk_type", "text", paper).withColumn("place", F.row_number().over(Window.partitionBy(paper).orderBy("ordinal")))
    steps = each.join(placed.select(F.col("chunk_id").alias("key"), paper, F.col("place").alias("at")), "key").withColumn("d", F.explode(F.expr("sequence(-k, k)"))).where("d <> 0").withColumn("place", F.col("at") + F.col("d"))
    row = F.struct("d", "chunk_id", "ordinal", "section", "chunk_type", "text", (-0.01 * F.abs("d")).alias("score"))
    lists = steps.join(placed, [paper, "place"]).groupBy("qid", "key", "k").agg(F.to_json(F.array_sort(F.collect_list(row))).alias("rows"))
    return each.join(lists, ["qid", "key", "k"], "left").select("qid", "kind", "key", "k", F.coalesce("rows", F.lit("[]")).alias("rows"))


def run_indexed(chunks: DataFrame, questions: DataFrame, top_k: int = 5, policy=rule_policy, max_steps: int = MAX_STEPS, paper: str = "doc_id", retrieve=bm25.retrieve) -> DataFrame:
    """The loop for each question (qid, question, query_type, profile, rewrites) over the whole index.

    Loops run until a look-up isn't known; those of all questions are then made together, by one retrieval over
    ``chunks`` (chunk_id, ordinal, section, chunk_type, text and the document's column) and one join for neighbours, and
    the loops that asked run again. So the policy has to give the same calls for the same observations. There are at
    most as many passes as a loop has look-ups.
    """
    spark = chunks.sparkSession
    rest = questions.select("qid", "question", "query_type", F.to_json("profile").alias("profile"), "rewrites")
    known, done = spark.createDataFrame([], LOOKUPS), []
    index = bm25.Index(chunks) if retrieve is bm25.retrieve else chunks  # its counts are made once for all passes
    for _ in range(2 * max_steps + 1):
        held = known.groupBy("qid").agg(F.collect_list(F.struct("kind", "key", "k", "rows")).alias("known"))
        out = rest.join(held, "qid", "left").mapInPandas(_passes(policy, top_k, max_steps), _PASS).persist()
        done.append(out.where(F.size("needs") == 0).drop("needs"))
        needs = out.select("qid", F.explode("needs").alias("n")).select("qid", "n.*")
        if needs.isEmpty():
            break
        rest = rest.join(needs.select("qid").distinct(), "qid", "left_semi")
        known = known.unionByName(_searched(chunks, index, needs, retrieve)).unionByName(_beside(chunks, needs, paper)).persist()
    result = done[0]
    for x in done[1:]:
        result = result.unionByName(x)
    return result
