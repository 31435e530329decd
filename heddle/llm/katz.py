"""Katz backoff language model over words: counting, normalising and scoring.

For an n-gram of any order, p(w | h) = d_c c(h, w) / c(h) if it was seen, else
alpha(h) p(w | h'), h' being h without its first word: the recursion runs down the levels to
p(w) = d_c c(w) / N for a known word, else the share that discounting frees, which stands for
one unknown class. d_c are Good-Turing discounts of each level (Katz, counts up to ``K``).
alpha(h) = (1 - sum of seen p(w | h)) / (1 - sum of their p(w | h')), from exact sums, so every
context sums to one. A context (or the unigrams) whose discounts free nothing has one more in
its denominator. A text begins after as many begin marks as a context holds.

Texts are scored whole, every token. Rows of positions would not fit the cluster's disks,
so keys move in blocks. Documents form groups of about ``GROUP_BYTES`` in a bucketed table.
A group sends its distinct keys, sorted, cut into ranges, with training counts; the task
of a range adds them up, keeps the count table, marks for every n-gram the first group
that has it, and answers with the global counts. That group adds the n-gram to the sums
of its context, which go the same way, a level after the other as the lower one's
probabilities are in the sums, and come back as denominators and backoff weights.
Hot words or pairs are one key per group, whatever their counts. There is a range for every
``RANGE_BYTES`` of input, and one a shuffle partition at least.

The count and context tables stay in the shared folder, a file part for each level and range.
``score`` trains and scores in one exchange, as texts that train are scored too; ``Stored``
(from ``train``) scores any other texts from the tables.

Words and n-grams are named by 64-bit hashes. Null and empty texts are one end token; texts
of any length are scored whole. Repeated rows count and are scored each. With no training
rows every token is unknown with probability one; an empty table gives no rows. Rows with a
null id do not train. Only the id and text columns are read, whatever the others' names.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from heddle.llm.chunks import coded
from heddle.llm.common import materialise, new_path, remove
from heddle.llm.shingles import mix

GROUP_BYTES = 12_000_000
RANGE_BYTES = 64_000_000
K = 5
END, BEGIN = np.uint64(xxhash.xxh3_64_intdigest(b"\n")), np.uint64(xxhash.xxh3_64_intdigest(b"\n\n"))
CONTEXTS = 100  # level of the contexts of n-grams of level k: CONTEXTS + k
ROW = "kind string, level int, range int, grp long, keys binary, values binary, types long, total long, spectrum array<long>"


# -- blocks ---------------------------------------------------------------------------


def _planes(x: np.ndarray) -> bytes:
    """Bytes of equal weight side by side: the shuffle's compression removes the empty ones."""
    return np.ascontiguousarray(x.view(np.uint8).reshape(len(x), x.itemsize).T).tobytes()


def _flat(data: bytes, kind) -> np.ndarray:
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(size, -1).T).view(kind).ravel()


def pack_keys(keys: np.ndarray) -> bytes:
    return _planes(np.diff(keys, prepend=np.uint64(0)))


def unpack_keys(data: bytes) -> np.ndarray:
    return np.cumsum(_flat(data, np.uint64), dtype=np.uint64)


def cuts(keys: np.ndarray, ranges: int) -> np.ndarray:
    """Ends of the ranges in sorted 64-bit keys."""
    return np.searchsorted((keys >> np.uint64(32)) * np.uint64(ranges) >> np.uint64(32), np.arange(ranges), side="right")


# -- a group's tokens -------------------------------------------------------------------


@dataclass
class Group:
    keys: list[np.ndarray]  # by level - 1: sorted distinct n-gram keys
    at: list[np.ndarray]  # by level - 1: per token, the place of its n-gram in keys
    contexts: list[np.ndarray]  # by level - 2: sorted distinct keys of the contexts
    before: list[np.ndarray]  # by level - 2: per token, the place of its context
    doc: np.ndarray  # per token
    train: np.ndarray  # per document


def tokens(texts: pa.Array, train: np.ndarray, order: int) -> Group:
    codes, ends, chunks = coded(pc.ascii_lower(texts))
    hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, chunks.to_pylist()), np.uint64, len(chunks))
    words, place = np.unique(np.concatenate([hashes, [END]]), return_inverse=True)
    n = len(ends)
    word = np.empty(len(codes) + n, np.int64)
    last = ends + np.arange(n)
    inner = np.ones(len(word), bool)
    inner[last] = False
    word[inner] = place[codes]
    word[last] = place[-1]
    first = np.concatenate(([0], last[:-1] + 1)) if n else last
    keys, at, contexts, before = [words], [word], [], []
    gram, blank = words[word], BEGIN
    for _ in range(2, order + 1):  # a level's n-grams: the shorter one that ends a token before, and the token
        context = np.concatenate(([blank], gram[:-1]))[: len(gram)]
        context[first] = blank
        gram, blank = mix(mix(context) + words[word]), mix(mix(np.array([blank])) + BEGIN)[0]
        for values, names, places in ((context, contexts, before), (gram, keys, at)):
            distinct, own = np.unique(values, return_inverse=True)
            names.append(distinct)
            places.append(own)
    return Group(keys, at, contexts, before, np.repeat(np.arange(n), np.diff(np.concatenate(([0], ends))) + 1), train)


def _table(rows: list[dict]) -> pa.Table:
    names = {"kind": pa.string(), "level": pa.int32(), "range": pa.int32(), "grp": pa.int64(), "keys": pa.binary(), "values": pa.binary(), "types": pa.int64(), "total": pa.int64(), "spectrum": pa.list_(pa.int64())}
    return pa.table({n: pa.array([r.get(n) for r in rows], t) for n, t in names.items()})


def _blocks(level: int, grp: int, keys: np.ndarray, values: list[np.ndarray], ranges: int) -> list[dict]:
    edges = [0, *cuts(keys, ranges).tolist()]
    return [{"kind": "ask", "level": level, "range": k, "grp": grp, "keys": pack_keys(keys[a:b]), "values": b"".join(_planes(v[a:b]) for v in values)} for k, (a, b) in enumerate(zip(edges, edges[1:], strict=False)) if a < b]


# -- the ranges' tasks --------------------------------------------------------------------


def _gathered(asked: pa.Table) -> tuple[list[int], list[np.ndarray], list[bytes], np.ndarray, np.ndarray]:
    rows = sorted(zip(asked.column("grp").to_pylist(), asked.column("keys").to_pylist(), asked.column("values").to_pylist(), strict=True))
    keys = [unpack_keys(k) for _, k, _ in rows]
    distinct, place = np.unique(np.concatenate(keys), return_inverse=True)
    return [g for g, _, _ in rows], keys, [v for _, _, v in rows], distinct, place


def count_range(asked: pa.Table) -> pa.Table:
    """Global counts of a range of n-grams: its part of the table, and an answer per group (2 * count + first)."""
    level, number = asked.column("level")[0].as_py(), asked.column("range")[0].as_py()
    groups, keys, values, distinct, place = _gathered(asked)
    counts = np.concatenate([_flat(v, np.uint32) for v in values]).astype(np.int64)
    total = np.bincount(place, counts, len(distinct)).astype(np.int64)
    holds = np.flatnonzero(counts)
    first = np.zeros(len(place), np.uint64)
    _, at = np.unique(place[holds], return_index=True)  # groups are in order, so this is the first group
    first[holds[at]] = 1
    answer = total[place].astype(np.uint64) * np.uint64(2) + first
    narrow = answer.astype(np.uint32) if len(answer) and answer.max() < 2**32 else answer
    kept = total > 0
    spectrum = np.bincount(np.minimum(total[kept], K + 2), minlength=K + 3)[: K + 2]
    out = [{"kind": "table", "level": level, "range": number, "keys": pack_keys(distinct[kept]), "values": _planes(total[kept]), "types": int(kept.sum()), "total": int(total.sum()), "spectrum": spectrum.tolist()}]
    edges = np.concatenate(([0], np.cumsum([len(k) for k in keys]))).tolist()
    out += [{"kind": "answer", "level": level, "range": number, "grp": g, "values": _planes(narrow[a:b]), "types": narrow.itemsize} for g, a, b in zip(groups, edges, edges[1:], strict=False)]
    return _table(out)


def sum_range(asked: pa.Table) -> pa.Table:
    """Contexts of a range: their sums, and (log10 of the denominator, log10 of alpha) per group."""
    level, number = asked.column("level")[0].as_py(), asked.column("range")[0].as_py()
    groups, keys, values, distinct, place = _gathered(asked)
    sums = []
    for j, kind in enumerate((np.int64, np.float64, np.float64)):
        parts = [_flat(v[8 * j * len(k) : 8 * (j + 1) * len(k)], kind) for v, k in zip(values, keys, strict=True)]
        sums.append(np.bincount(place, np.concatenate(parts), len(distinct)))
    logs = np.stack(weights(*sums), 1)
    held = sums[0] > 0  # other contexts have a denominator and a weight of one
    out = [{"kind": "table", "level": level, "range": number, "keys": pack_keys(distinct[held]), "values": logs[held].tobytes(), "types": int(held.sum())}]
    edges = np.concatenate(([0], np.cumsum([len(k) for k in keys]))).tolist()
    out += [{"kind": "answer", "level": level, "range": number, "grp": g, "values": logs[place[a:b]].tobytes(), "types": 8} for g, a, b in zip(groups, edges, edges[1:], strict=False)]
    return _table(out)


def look_up(asked: pa.Table, table: pa.Table) -> pa.Table:
    """Answers of a range from its stored table: 2 * count of n-grams, (log10 of the denominator, log10 of alpha) of contexts."""
    if not asked.num_rows:
        return _table([])
    level, number = asked.column("level")[0].as_py(), asked.column("range")[0].as_py()
    stored = unpack_keys(table.column("keys")[0].as_py()) if table.num_rows else np.zeros(0, np.uint64)
    data = table.column("values")[0].as_py() if table.num_rows else b""
    values = np.frombuffer(data, np.float64).reshape(-1, 2) if level > CONTEXTS else _flat(data, np.int64) * 2 if len(stored) else np.zeros(0, np.int64)
    out = []
    for grp, packed in zip(asked.column("grp").to_pylist(), asked.column("keys").to_pylist(), strict=True):
        keys = unpack_keys(packed)
        place = np.searchsorted(stored, keys)
        hit = place < len(stored)
        hit[hit] = stored[place[hit]] == keys[hit]
        found = np.zeros((len(keys), *values.shape[1:]), values.dtype)
        found[hit] = values[place[hit]]
        data = found.tobytes() if level > CONTEXTS else _planes(found.astype(np.uint64))
        out.append({"kind": "answer", "level": level, "range": number, "grp": grp, "values": data, "types": 8})
    return _table(out)


# -- probabilities -------------------------------------------------------------------------


def weights(count: np.ndarray, discounted: np.ndarray, lower: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """log10 of denominator and of alpha, from a context's count, sum of d_c c and sum of the seen words' p(w)."""
    denominator = np.maximum(count, 1.0)
    none = (count > 0) & (1 - discounted / denominator < 1e-9)
    denominator = denominator + none
    free = np.where(count > 0, 1 - discounted / denominator, 1.0)
    rest = np.where(count > 0, np.maximum(1 - lower, 1e-300), 1.0)
    return np.log10(denominator), np.log10(np.maximum(free, 1e-300) / rest)


def discounts(spectrum: list[int]) -> np.ndarray:
    """d_0 .. d_K (then 1) from the numbers of n-grams seen r times; 1 where Good-Turing gives no discount."""
    n = [float(x) for x in spectrum]
    d = np.ones(K + 2)
    if n[1] > 0:
        common = (K + 1) * n[K + 1] / n[1]
        for r in range(1, K + 1):
            if n[r] > 0 and common < 1:
                value = ((r + 1) * n[r + 1] / n[r] / r - common) / (1 - common)
                d[r] = value if 0 < value <= 1 else 1.0
    return d


@dataclass
class Model:
    tokens: int
    types: int
    order: int
    discounts: list[np.ndarray]  # by level - 1, then by count
    denominator: float
    unknown: float  # log10 probability of the unknown class

    def discounted(self, counts: np.ndarray, level: int) -> np.ndarray:
        return self.discounts[level - 1][np.minimum(counts, K + 1)] * counts

    def logs(self, level: int, g: Group, counts: list[np.ndarray], contexts: list[np.ndarray]) -> np.ndarray:
        """log10 p of every token given the level - 1 tokens before it, by Katz's recursion.

        counts: by level, of the group's n-grams; contexts: by level - 2, of the group's contexts.
        """
        own = counts[level - 1][g.at[level - 1]]
        with np.errstate(divide="ignore"):
            seen = np.log10(self.discounted(own, level))
        if level == 1:
            return np.where(own > 0, seen - np.log10(self.denominator), self.unknown)
        below, alpha = contexts[level - 2][g.before[level - 2]].T
        return np.where(own > 0, seen - below, alpha + self.logs(level - 1, g, counts, contexts))


def model_of(total: int, types: int, spectra: list[list[int]]) -> Model:
    words = spectra[0]
    d = discounts(words)
    low = sum(r * words[r] for r in range(1, K + 1))
    kept = sum(d[r] * r * words[r] for r in range(1, K + 1)) + (total - low)
    denominator = float(total) if total and 1 - kept / total > 1e-9 else total + 1.0
    return Model(total, types, len(spectra), [discounts(s) for s in spectra], denominator, float(np.log10(1 - kept / denominator)))


# -- dataflow --------------------------------------------------------------------------------


def _grouped(docs: DataFrame, ranges: int) -> tuple[DataFrame, str, str]:
    """(grp, doc_id, train, held_out, text), bucketed by grp: groups are runs of rows of one input partition."""
    spark = docs.sparkSession

    def number(batches):
        size, count, part = 0, 0, TaskContext.get().partitionId()
        for batch in batches:
            sizes = pc.fill_null(pc.binary_length(batch.column("text")), 0).to_numpy(zero_copy_only=False)
            grp = np.empty(len(sizes), np.int64)
            for i, own in enumerate(sizes.tolist()):
                if size and size + own > GROUP_BYTES:
                    size, count = 0, count + 1
                size += own + 1
                grp[i] = part << 24 | count
            yield pa.RecordBatch.from_arrays([pa.array(grp), *batch.columns], ["grp", *batch.schema.names])

    path, name = new_path(spark, "groups"), f"heddle_groups_{uuid.uuid4().hex}"
    numbered = docs.mapInArrow(number, f"grp long, doc_id {docs.schema['doc_id'].dataType.simpleString()}, train boolean, held_out boolean, text string")
    numbered.write.option("compression", "zstd").option("path", path).bucketBy(ranges, "grp").saveAsTable(name)
    return spark.table(name), name, path


def _exchange(asked: DataFrame, task, path: str) -> DataFrame:
    """Answers and tables of all ranges, written by kind and level."""
    asked.groupBy("level", "range").applyInArrow(task, ROW).write.option("compression", "zstd").partitionBy("kind", "level").mode("append").parquet(path)
    return asked.sparkSession.read.schema(ROW).parquet(path)


def _answers(answers: pa.Table, level: int) -> np.ndarray:
    """A level's answers in the order of the group's keys: 2 * count + first, or rows of two logs."""
    rows = sorted((k, v, size) for lv, k, v, size in zip(*(answers.column(c).to_pylist() for c in ("level", "range", "values", "types")), strict=True) if lv == level)
    if level > CONTEXTS:
        return np.concatenate([np.frombuffer(v, np.float64) for _, v, _ in rows]).reshape(-1, 2) if rows else np.zeros((0, 2))
    return np.concatenate([_flat(v, np.uint32 if size == 4 else np.uint64).astype(np.int64) for _, v, size in rows]) if rows else np.zeros(0, np.int64)


def _group_of(table: pa.Table, order: int) -> Group:
    return tokens(table.column("text").combine_chunks(), table.column("train").to_numpy(), order)


def _evaluated(model: Model, id_type: str):
    """The last step: (group's texts, answers) to rows."""

    def evaluate(left: pa.Table, right: pa.Table) -> pa.Table:
        g = _group_of(left, model.order)
        counts = [_answers(right, level) >> 1 for level in range(1, model.order + 1)]
        log = model.logs(model.order, g, counts, [_answers(right, CONTEXTS + level) for level in range(2, model.order + 1)])
        n = left.num_rows
        known = counts[0][g.at[0]]
        base = np.log10((known + 1) / (model.tokens + (model.types + 1)))
        return pa.table(
            {
                "doc_id": left.column("doc_id").combine_chunks(),
                "held_out": left.column("held_out").combine_chunks(),
                "n_tokens": pa.array(np.bincount(g.doc, minlength=n)),
                "n_known": pa.array(np.bincount(g.doc[known > 0], minlength=n)),
                "train_tokens": pa.array(np.full(n, model.tokens)),
                "base_score": pa.array(np.bincount(g.doc, base, n)),
                "score": pa.array(np.bincount(g.doc, log, n)),
            }
        )

    return evaluate, f"doc_id {id_type}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


@dataclass
class Stored:
    """A trained model: its numbers, and its tables by level and range in the shared folder."""

    model: Model
    path: str
    ranges: int

    def score(self, docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
        """The rows of ``score`` for other texts (held_out is true), from the stored tables."""
        order, ranges = self.model.order, self.ranges
        spark = docs.sparkSession
        rows = docs.select(F.col(id_col).alias("doc_id"), F.lit(False).alias("train"), F.lit(True).alias("held_out"), F.col(text_col).alias("text"))
        with Groups(rows, ranges) as groups:

            def ask(table: pa.Table) -> pa.Table:
                g, grp = _group_of(table, order), table.column("grp")[0].as_py()
                levels = [*enumerate(g.keys, 1), *enumerate(g.contexts, CONTEXTS + 2)]
                return _table([b for level, keys in levels for b in _blocks(level, grp, keys, [], ranges)])

            asked = groups.own.groupBy("grp").applyInArrow(ask, ROW)
            tables = spark.read.schema(ROW).parquet(self.path).where("kind = 'table'")
            answers = asked.groupBy("level", "range").cogroup(tables.groupBy("level", "range")).applyInArrow(look_up, ROW).select("grp", "level", "range", "values", "types")
            scored = groups.rows.groupBy("grp").cogroup(answers.groupBy("grp")).applyInArrow(*_evaluated(self.model, docs.schema[id_col].dataType.simpleString()))
            return materialise(scored, "scores")


class Groups:
    """The texts in groups, as a bucketed table that is gone when the block ends."""

    def __init__(self, rows: DataFrame, ranges: int):
        self.spark = rows.sparkSession
        self.rows, self.name, self.path = _grouped(rows, ranges)
        self.own = self.rows.select("grp", "train", "text")

    def __enter__(self) -> Groups:
        return self

    def __exit__(self, *_) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {self.name}")
        remove(self.spark, self.path)


def range_count(docs: DataFrame) -> int:
    """Ranges by the bytes of the input, so that a range's task stays as large as it is when the input grows."""
    size = docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()
    known = min(int(str(size)), 1 << 50)  # an unknown size is stated as the largest long
    least = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return least if known == 1 << 50 else max(least, -(-known // RANGE_BYTES))


def _context_sums(model: Model, level: int, ranges: int):
    """(group's texts, answers of the levels below) to the sums of its contexts, from the n-grams it is the first to have."""
    order = model.order

    def ask_contexts(left: pa.Table, right: pa.Table) -> pa.Table:
        g, grp = _group_of(left, order), left.column("grp")[0].as_py()
        packed = [_answers(right, k) for k in range(1, level + 1)]
        counts = [x >> 1 for x in packed]
        lower = model.logs(level - 1, g, counts, [_answers(right, CONTEXTS + k) for k in range(2, level)])
        first = (packed[-1] & 1).astype(bool)
        _, some = np.unique(g.at[level - 1], return_index=True)  # a token of every n-gram
        some = some[first]
        context, seen, n = g.before[level - 2][some], counts[-1][first], len(g.contexts[level - 2])
        total = np.bincount(context, seen, n).astype(np.int64)
        freed = np.bincount(context, model.discounted(seen, level), n)
        below = np.bincount(context, 10.0 ** lower[some], n)
        return _table(_blocks(CONTEXTS + level, grp, g.contexts[level - 2], [total, freed, below], ranges))

    return ask_contexts


def _trained(groups: Groups, order: int, ranges: int, path: str) -> tuple[Model, DataFrame]:
    """The model's numbers and the answers of all levels by group; the tables are written below path."""
    own = groups.own

    def ask_counts(table: pa.Table) -> pa.Table:
        g, grp = _group_of(table, order), table.column("grp")[0].as_py()
        on = g.train[g.doc]
        counts = [np.bincount(at[on], minlength=len(keys)).astype(np.uint32) for keys, at in zip(g.keys, g.at, strict=True)]
        return _table([b for level, (keys, c) in enumerate(zip(g.keys, counts, strict=True), 1) for b in _blocks(level, grp, keys, [c], ranges)])

    held = _exchange(own.groupBy("grp").applyInArrow(ask_counts, ROW), count_range, path)
    sums = {r["level"]: r for r in held.where("kind = 'table'").groupBy("level").agg(F.sum("types").alias("types"), F.sum("total").alias("total"), F.array(*[F.sum(F.col("spectrum")[r]) for r in range(K + 2)]).alias("spectrum")).collect()}  # a row per level
    none = {"types": 0, "total": 0, "spectrum": [0] * (K + 2)}
    words = sums.get(1, none)
    model = model_of(words["total"], words["types"], [sums.get(level, none)["spectrum"] for level in range(1, order + 1)])
    answers = held.where("kind = 'answer'").select("grp", "level", "range", "values", "types")

    for level in range(2, order + 1):
        usable = answers.where(F.col("level") <= level) if level == 2 else answers.where((F.col("level") <= level) | (F.col("level").between(CONTEXTS + 2, CONTEXTS + level - 1)))
        asked = own.groupBy("grp").cogroup(usable.groupBy("grp")).applyInArrow(_context_sums(model, level, ranges), ROW)
        answers = _exchange(asked, sum_range, path).where("kind = 'answer'").select("grp", "level", "range", "values", "types")
    return model, answers


def train(docs: DataFrame, *, order: int = 2, id_col: str = "doc_id", text_col: str = "text", path: str | None = None) -> Stored:
    """A model of all rows with an id, kept as tables below path (a new folder of the shared one)."""
    ranges = range_count(docs)
    path = path or new_path(docs.sparkSession, "katz")
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(id_col).isNotNull().alias("train"), F.lit(False).alias("held_out"), F.col(text_col).alias("text"))
    with Groups(rows, ranges) as groups:
        model, _ = _trained(groups, order, ranges, path)
    remove(docs.sparkSession, f"{path}/kind=answer")
    return Stored(model, path, ranges)


def score(docs: DataFrame, held_out, *, order: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    held_out: boolean column; rows where it is false train the model.
    """
    spark = docs.sparkSession
    ranges = range_count(docs)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(~held_out & F.col(id_col).isNotNull(), F.lit(False)).alias("train"), F.coalesce(held_out, F.lit(False)).alias("held_out"), F.col(text_col).alias("text"))
    path = new_path(spark, "katz")
    with Groups(rows, ranges) as groups:
        model, answers = _trained(groups, order, ranges, path)
        scored = groups.rows.groupBy("grp").cogroup(answers.groupBy("grp")).applyInArrow(*_evaluated(model, docs.schema[id_col].dataType.simpleString()))
        out = materialise(scored, "scores")
    remove(spark, path)
    return out
