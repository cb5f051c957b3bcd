"""The best documents of every query, from matches in the order of ``ord``, without a row for each pair of query and document.

Each task keeps the best k of every query among the documents that it has seen. Documents come in the order of ``ord`` and
ties keep the smaller one, so that a later document has to score more than the k-th. Matches are worked off in blocks: a
query is left out of a block whose tokens and fields cannot exceed its k-th score, and in other blocks only documents are
scored that hold a token without which the k-th score cannot be exceeded. Both follow from upper bounds, so the result is
that of scoring every pair.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

#: Matches in the first and in the largest block of a task; each block has twice as many as the one before.
FIRST_BLOCK, LARGEST_BLOCK = 1 << 15, 1 << 20
#: Matches for which a task is worth while, and of a task at most, where the cores allow for fewer tasks.
LEAST_TASK, MOST_TASK = 250_000, 8_000_000
#: Added to a bound before it is rounded, against sums in another order.
SLACK = 1e-9


@dataclass(frozen=True)
class Weights:
    """Tokens of all queries, those of one query together; ``names`` are the distinct tokens, ``token`` their places."""

    names: pa.Array
    query: np.ndarray
    start: np.ndarray
    token: np.ndarray
    n: np.ndarray
    weight: np.ndarray
    required: np.ndarray

    @classmethod
    def of(cls, rows: pa.Table) -> Weights:
        """From rows (query_no, token, n, weight, required); the tokens of a query by falling weight."""
        number, weight = rows["query_no"].to_numpy(), rows["weight"].to_numpy()
        order = np.lexsort((-weight, number))
        coded = rows["token"].combine_chunks().dictionary_encode()
        query, start = np.unique(number[order], return_index=True)
        column = lambda name: rows[name].to_numpy()[order]
        return cls(coded.dictionary, query, np.append(start, len(order)), coded.indices.to_numpy()[order], column("n"), weight[order], column("required")[start])


@dataclass(frozen=True)
class Score:
    """``round(max(a, b) + tie_breaker * min(a, b), digits)`` of the boosted sums a and b of two fields; nothing is negative."""

    title_boost: float
    text_boost: float
    tie_breaker: float
    digits: int

    def __call__(self, title: np.ndarray, text: np.ndarray, slack: float = 0.0) -> np.ndarray:
        a, b = title * self.title_boost, text * self.text_boost
        return np.round(np.maximum(a, b) + self.tie_breaker * np.minimum(a, b) + slack, self.digits)


class _Best:
    """The best ``size`` documents of each query so far; scores of 0 are no results."""

    def __init__(self, queries: Weights, score: Score, size: int) -> None:
        self.queries, self.score, self.size = queries, score, size
        self.scores = np.zeros((len(queries.query), size))
        self.places = np.full((len(queries.query), size), -1)
        self.ords: list[pa.Array] = []
        self.seen = 0

    def add(self, ords: pa.Array, doc: np.ndarray, token: np.ndarray, in_title: np.ndarray, in_text: np.ndarray) -> None:
        """A block: the ``ords`` of its documents, and its matches in the order of their documents."""
        by_token = np.argsort(token, kind="stable")
        self.docs, self.in_title, self.in_text = doc[by_token], in_title[by_token].astype(float), in_text[by_token].astype(float)
        names = len(self.queries.names)
        self.first = np.searchsorted(token[by_token], np.arange(names + 1))
        self.slot, self.mark = np.full(len(ords), -1), np.zeros(len(ords), bool)
        in_block = lambda flags: np.bincount(token, flags, names) > 0
        q = self.queries
        title, text = q.weight * in_block(in_title)[q.token], q.weight * in_block(in_text)[q.token]
        bound = self.score(np.add.reduceat(title, q.start[:-1]), np.add.reduceat(text, q.start[:-1]), SLACK)
        for i in np.flatnonzero(bound > self.scores[:, -1]).tolist():
            self._add_to(i, title[q.start[i] : q.start[i + 1]], text[q.start[i] : q.start[i + 1]])
        self.ords.append(ords)
        self.seen += len(ords)

    def _add_to(self, i: int, title: np.ndarray, text: np.ndarray) -> None:
        q, least = self.queries, self.scores[i, -1]
        rest = self.score(title[::-1].cumsum()[::-1], text[::-1].cumsum()[::-1], SLACK)  # of documents without the tokens before
        needed = int(np.count_nonzero(rest > least))
        tokens = range(q.start[i], q.start[i + 1])
        spans = [(self.first[t], self.first[t + 1]) for t in q.token[tokens.start : tokens.stop]]
        for lo, hi in spans[:needed]:
            self.mark[self.docs[lo:hi]] = True
        docs = np.flatnonzero(self.mark)
        self.mark[docs] = False
        self.slot[docs] = np.arange(len(docs))
        of_title, of_text, matched = np.zeros(len(docs)), np.zeros(len(docs)), np.zeros(len(docs), np.int64)
        for at, (lo, hi) in zip(tokens, spans, strict=True):
            if hi - lo > 8 * len(docs):
                places = lo + np.searchsorted(self.docs[lo:hi], docs)
                held = np.flatnonzero(self.docs[np.minimum(places, hi - 1)] == docs)
                places = places[held]
            else:
                held, places = self.slot[self.docs[lo:hi]], slice(lo, hi)
                if at - tokens.start >= needed:
                    places = lo + np.flatnonzero(held >= 0)
                    held = held[held >= 0]
            of_title[held] += q.weight[at] * self.in_title[places]
            of_text[held] += q.weight[at] * self.in_text[places]
            matched[held] += q.n[at]
        self.slot[docs] = -1
        scores = self.score(of_title, of_text)
        better = np.flatnonzero((scores > least) & (matched >= q.required[i]))
        if len(better) > self.size:
            better = better[scores[better] >= np.partition(scores[better], -self.size)[-self.size]]
        # a stable order: of equal scores those seen before, then in the order of their documents
        scores, places = np.append(self.scores[i], scores[better]), np.append(self.places[i], self.seen + docs[better])
        order = np.argsort(-scores, kind="stable")[: self.size]
        self.scores[i], self.places[i] = scores[order], places[order]

    def rows(self) -> pa.RecordBatch:
        held = self.places >= 0
        ords = pa.concat_arrays(self.ords).take(pa.array(self.places[held]))
        query = np.repeat(self.queries.query, held.sum(axis=1))
        return pa.RecordBatch.from_arrays([pa.array(query, pa.int64()), ords, pa.array(self.scores[held], pa.float64())], names=["query_no", "ord", "score"])


def best_documents(found: DataFrame, rows: pa.Table, score: Score, size: int) -> DataFrame:
    """(query_no, ord, score): the best ``size`` documents of each query in each task, so its best ones are among them.

    ``found`` (ord, token, in_title, in_text) has each token of a document once; ``rows`` are those of :class:`Weights`.
    """
    kind, context = found.schema["ord"].dataType.simpleString(), found.sparkSession.sparkContext
    schema = f"query_no long, ord {kind}, score double"
    if not rows.num_rows:
        return found.sparkSession.createDataFrame([], schema)
    shared = context.broadcast(Weights.of(rows))

    def scan(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queries = shared.value
        best, held, n_held, block = _Best(queries, score, size), [], 0, FIRST_BLOCK

        def add(all_of_them: bool) -> list[pa.RecordBatch]:
            """Works off the documents that are complete; gives back the matches of the others."""
            table = pa.Table.from_batches(held).combine_chunks()
            coded = pc.dictionary_encode(table["ord"].combine_chunks(), null_encoding="encode")
            doc, n_docs = coded.indices.to_numpy(), len(coded.dictionary)
            end = len(doc) if all_of_them else int(np.searchsorted(doc, n_docs - 1))
            column = lambda name: table[name].to_numpy()[:end]
            ords = coded.dictionary if all_of_them else coded.dictionary[: n_docs - 1]
            best.add(ords, doc[:end], column("token_no"), column("in_title"), column("in_text"))
            return table.slice(end).to_batches()

        for batch in batches:
            number = pc.index_in(batch.column("token"), value_set=queries.names)
            known = number.is_valid()
            columns = [batch.column("ord"), number, batch.column("in_title"), batch.column("in_text")]
            part = pa.RecordBatch.from_arrays(columns, names=["ord", "token_no", "in_title", "in_text"]).filter(known)
            if part.num_rows:
                held.append(part)
                n_held += part.num_rows
            if n_held >= block:
                held = add(False)
                n_held, block = sum(b.num_rows for b in held), min(2 * block, LARGEST_BLOCK)
        if n_held:
            held = add(True)
            yield best.rows()
        elif best.seen:
            yield best.rows()

    n = found.count()
    tasks = max(-(-n // MOST_TASK), min(context.defaultParallelism, -(-n // LEAST_TASK)), 1)
    columns = found.select("ord", "token", "in_title", "in_text")
    return columns.repartition(tasks, "ord").sortWithinPartitions("ord").mapInArrow(scan, schema)
