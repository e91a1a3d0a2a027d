"""Retrieval in hops: each round asks all queries that are still open at once, and a query leaves when it has settled."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import strip
from ..operators import fusion
from ..shared import store
from .pipeline import Pipeline

#: Characters of a partial answer that the follow-up is made from.
PARTIAL = 500


def iterative_hops(run: Pipeline, queries: DataFrame, follow_up: Callable[[DataFrame], DataFrame], embed: Callable[[DataFrame], DataFrame], generate: Callable[[str, str], str] | None = None, max_hops: int = 3) -> tuple[DataFrame, DataFrame]:
    """(answers, candidates) of queries (query_id, query, embedding).

    A hop retrieves for the current questions and answers them (``Pipeline.answers``). ``follow_up`` gets (query_id, question:
    the original one, asked: the current one, partial: the answer's first ``PARTIAL`` characters) and returns (query_id,
    next); a query settles when that is null, blank (quotes around it do not count) or the question asked just now, or after
    ``max_hops``. ``embed`` adds the embedding to (query_id, query). Answers: query_id, answer of the last hop, hops,
    questions in order. Candidates: every hop's, each once, earlier hops first.

    The state of all queries is a table of one row a query, stored after each round; a round is one plan for all open ones.
    """
    if max_hops < 1:
        raise ValueError("at least one hop")
    original = queries.select("query_id", F.col("query").alias("question"))
    open_queries, done, found = queries.select("query_id", "query", "embedding"), [], []
    history = original.select("query_id", F.array().cast("array<string>").alias("questions"))
    for hop in range(max_hops):
        hits = store(run.retrieve(open_queries), "hop-hits")
        found.append(hits.select("query_id", "cid", "rank", F.lit(hop).alias("hop")))
        answered = open_queries.select("query_id", "query").join(run.answers(hits, generate), "query_id", "left").join(history, "query_id")
        state = store(answered.select("query_id", F.col("query").alias("asked"), "answer", F.concat("questions", F.array("query")).alias("questions")), "hop-state")
        if hop == max_hops - 1:
            done.append(state.withColumn("hops", F.lit(hop + 1)))
            break
        said = follow_up(state.join(original, "query_id").select("query_id", "question", "asked", F.substring(F.coalesce("answer", F.lit("")), 1, PARTIAL).alias("partial")))
        # Quotes around the model's question go, and only then blanks inside them.
        clean = F.regexp_replace(strip(F.coalesce("next", F.lit(""))), "^\"+|\"+$", "")
        said = said.select("query_id", F.regexp_replace(clean, "^'+|'+$", "").alias("next"))
        moved = store(state.join(said, "query_id", "left").withColumn("next", F.coalesce("next", F.lit(""))), "hop-next")
        settled = (F.col("next") == "") | (F.lower(strip(F.col("next"))) == F.lower(strip(F.col("asked"))))
        done.append(moved.where(settled).select("query_id", "asked", "answer", "questions", F.lit(hop + 1).alias("hops")))
        rest = moved.where(~settled)
        if rest.isEmpty():
            break
        open_queries = store(embed(rest.select("query_id", F.col("next").alias("query"))).select("query_id", "query", "embedding"), "hop-queries")
        history = moved.select("query_id", "questions")
    answers = done[0]
    for more in done[1:]:
        answers = answers.unionByName(more)
    candidates = found[0]
    for more in found[1:]:
        candidates = candidates.unionByName(more)
    return answers.select("query_id", "answer", "hops", "questions"), fusion.union_hops(candidates, 1 << 30)
