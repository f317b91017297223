"""URL filters: host and path rules, and for the rest a ratio of two character language models.

The models are variable-order Markov chains over 64 symbols, one for accepted and one for rejected URLs,
smoothed by Witten-Bell interpolation down to the uniform distribution. Contexts of up to four symbols are
hashed, so the counts are a table of fixed size, summed over all labelled URLs. The difference of the two
log-likelihoods, divided by the length, is calibrated by a logistic curve on URLs kept out of the counts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .arrays import buffer, mix
from .common import ascii_lower, drawn, slices

ORDERS, CONTEXTS, SYMBOLS = 5, 1 << 12, 64
CELLS = ORDERS * CONTEXTS * SYMBOLS
#: Different labelled URLs that the calibration curve is fitted on, about at most, drawn by hash (``drawn``).
CALIBRATION_ROWS = 20_000
#: One symbol for each of these characters, two more for other ASCII and for other bytes.
ALPHABET = b"abcdefghijklmnopqrstuvwxyz0123456789-._~:/?#[]@!$&'()*+,;=%"
_SYMBOL = np.full(256, len(ALPHABET), np.uint64)
_SYMBOL[list(ALPHABET)] = np.arange(len(ALPHABET))
_SYMBOL[65:91] = _SYMBOL[97:123]
_SYMBOL[128:] = len(ALPHABET) + 1


def parts(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lowered) and path of a URL; empty for null or without ``://``."""
    text = F.coalesce(url.cast("string"), F.lit(""))
    at = F.instr(text, "://")
    rest = F.when(at > 0, F.substring(text, at + 3, F.length(text))).otherwise("")
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    return ascii_lower(host), F.regexp_extract(F.substring(rest, F.length(host) + 1, F.length(text)), r"^[^?#]*", 0)


def rule_of(host: Column, path: Column, rules: list[tuple[str, str]]) -> tuple[Column, Column]:
    """Verdict and rule of the longest of ``rules`` (verdict, "host/path") that fits, else nulls.

    A rule fits its host and all subdomains, if the path starts with the rule's. Of equally long rules
    the first in the list wins.
    """
    verdict = name = F.lit(None).cast("string")
    for kind, rule in reversed(sorted(rules, key=lambda r: -len(r[1]))):
        own, slash, rest = rule.partition("/")
        fits = ((host == own) | host.endswith("." + own)) & path.startswith(slash + rest)
        verdict, name = F.when(fits, F.lit(kind)).otherwise(verdict), F.when(fits, F.lit(rule)).otherwise(name)
    return verdict, name


def _cells(column: pa.Array) -> tuple[list[np.ndarray], np.ndarray]:
    """For each order the table cell of every symbol of the URLs, and the URLs' lengths."""
    flat, offsets = buffer(column)
    lengths = np.diff(offsets)
    depth = np.arange(len(flat)) - np.repeat(offsets[:-1], lengths)
    symbol = _SYMBOL[flat]
    context, cells = np.zeros(len(flat), np.uint64), []
    for k in range(ORDERS):
        bucket = mix(context + np.uint64(k)) % np.uint64(CONTEXTS)
        cells.append(((k * CONTEXTS + bucket.astype(np.int64)) * SYMBOLS + symbol.astype(np.int64)))
        if len(flat):  # one symbol further back; before the URL there is a mark of its own
            back = np.r_[np.zeros(k + 1, np.uint64), symbol[: len(flat) - k - 1]][: len(flat)]
            back[depth <= k] = SYMBOLS - 1
            context = context * np.uint64(SYMBOLS) + back + np.uint64(1)
    return cells, lengths


class Models:
    """Counts of accepted and rejected URLs, as (2, CELLS), and their log-likelihood difference."""

    def __init__(self, counts: np.ndarray):
        self.cells = counts.astype(np.float32)
        table = counts.reshape(2, -1, SYMBOLS)
        self.total, self.kinds = table.sum(2).astype(np.float32), (table > 0).sum(2).astype(np.float32)
        self.slope, self.offset = 1.0, 0.0

    def difference(self, column: pa.Array) -> np.ndarray:
        """log2 P(accepted) - log2 P(rejected) per symbol; 0 for an empty URL."""
        cells, lengths = _cells(column)
        logs = []
        for own, total, kinds in zip(self.cells, self.total, self.kinds, strict=True):
            p = np.full(len(cells[0]), 1 / SYMBOLS)
            for at in cells:
                n, t = total[at // SYMBOLS], kinds[at // SYMBOLS]
                p = np.where(n > 0, (own[at] + t * p) / np.maximum(n + t, 1), p)
            logs.append(np.log2(p))
        edges = np.r_[0, np.cumsum(lengths)]
        run = np.r_[0, np.cumsum(logs[0] - logs[1])]
        return (run[edges[1:]] - run[edges[:-1]]) / np.maximum(lengths, 1)

    def accepted(self, column: pa.Array) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * self.difference(column) + self.offset, -60, 60)))

    def calibrate(self, difference: np.ndarray, accepted: np.ndarray) -> None:
        """Newton steps for the logistic curve, with a weak pull to slope 1 and offset 0."""
        x, w = np.c_[difference, np.ones(len(difference))], np.array([1.0, 0.0])
        for _ in range(50):
            p = 1 / (1 + np.exp(-np.clip(x @ w, -60, 60)))
            grad = x.T @ (p - accepted) + 1e-2 * (w - [1, 0])
            step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + 1e-2 * np.eye(2), grad)
            w = w - np.clip(step, -5, 5)
        self.slope, self.offset = map(float, w)


def fit(labelled: DataFrame, calibration_rows: int = CALIBRATION_ROWS) -> Models | None:
    """Models from ``labelled`` (url, accepted), or None unless there are URLs of both kinds.

    Four fifths of the URLs, by hash, are counted; the curve is fitted on a bounded number of the others.
    """
    rows = labelled.where(F.col("url").isNotNull()).withColumn("part", F.pmod(F.xxhash64("url"), F.lit(5)))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, int] = {}
        for batch in slices(batches, "url", 1 << 20):
            kind = batch.column("accepted").to_numpy(zero_copy_only=False).astype(np.int64)
            cells, lengths = _cells(batch.column("url"))
            side = np.repeat(1 - kind, lengths) * CELLS
            for at in cells:
                found, n = np.unique(at + side, return_counts=True)
                for k, v in zip(found.tolist(), n.tolist(), strict=True):
                    total[k] = total.get(k, 0) + v
        yield pa.record_batch([pa.array(list(total), pa.int64()), pa.array(list(total.values()), pa.int64())], names=["cell", "n"])

    counted = rows.where("part != 0").select("url", "accepted").mapInArrow(count, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n"))
    counts = np.zeros(2 * CELLS)
    for batch in counted.toArrow().to_batches():  # 2 * CELLS rows at most
        counts[batch.column("cell").to_numpy()] = batch.column("n").to_numpy()
    counts = counts.reshape(2, CELLS)
    if not (counts[0].any() and counts[1].any()):
        return None
    models = Models(counts)
    held = drawn(rows.where("part = 0"), calibration_rows, "url", "accepted").toArrow().sort_by([("url", "ascending"), ("accepted", "ascending")])
    if held.num_rows:
        models.calibrate(models.difference(held["url"].combine_chunks()), held["accepted"].to_numpy().astype(float))
    return models


def judge(pages: DataFrame, rules: list[tuple[str, str]], threshold: float = 0.5, calibration_rows: int = CALIBRATION_ROWS) -> DataFrame:
    """page_id, host, path, rule, verdict and accepted (probability) of every row of ``pages`` (page_id, url).

    Where a rule fits its verdict holds. Otherwise the models, which learn from the URLs that rules decide,
    allow a URL if its probability reaches ``threshold``. Without URLs of both kinds, and for null and empty
    URLs, the probability is 1. Repeated rows each get a result, an empty table gives an empty result;
    other columns are ignored.
    """
    rows = pages.select("page_id", F.col("url").cast("string").alias("url"))
    host, path = parts(F.col("url"))
    rows = rows.withColumns({"host": host, "path": path})
    verdict, name = rule_of(F.col("host"), F.col("path"), rules)
    rows = rows.withColumns({"decided": verdict, "rule": name})
    models = fit(rows.where("decided IS NOT NULL").select("url", (F.col("decided") == "allow").alias("accepted")), calibration_rows)
    if models is None:
        scored = rows.withColumn("accepted", F.lit(1.0))
    else:
        shared = pages.sparkSession.sparkContext.broadcast(models)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in slices(batches, "url", 1 << 20):
                p = shared.value.accepted(batch.column("url"))
                lengths = pc.fill_null(pc.binary_length(batch.column("url")), 0).to_numpy(zero_copy_only=False)
                yield pa.record_batch([*batch.columns, pa.array(np.where(lengths > 0, p, 1.0))], names=[*batch.schema.names, "accepted"])

        scored = rows.mapInArrow(run, rows.withColumn("accepted", F.lit(1.0)).schema)
    by_model = F.when(F.col("accepted") >= threshold, "allow").otherwise("block")
    return scored.select("page_id", "host", "path", "rule", F.coalesce("decided", by_model).alias("verdict"), "accepted")
