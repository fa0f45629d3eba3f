"""Token ids in files of shards, each compressed by a grammar of id pairs."""

from __future__ import annotations

import json
import re
from array import array
from collections.abc import Callable, Iterator
from functools import lru_cache
from math import ceil
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import slices

#: Ids per shard; a shard ends with the document that reaches them.
SHARD_TOKENS = 1 << 18
#: Bytes of text per writing task.
TASK_BYTES = 16 << 20
#: A pair is replaced from so many places on; fewer would not pay for the rule.
LEAST_PAIRS = 4
#: A round takes the pairs that stand at least at this share of the places of the most frequent one.
ROUND_SHARE = 1 / 16
#: Buckets (less one) of the count that comes before the exact one; their counts fit a core's cache.
BUCKET = (1 << 18) - 1
#: Pieces of text whose ids a worker remembers, and the longest of them.
PIECES, LONGEST_PIECE = 200_000, 64
#: Runs of plain texts that it remembers; they are shorter.
MOST_RUNS = 400_000

_FORMAT = (
    "part int, number int, tokens bigint, first {kind}, last {kind}, docs array<{kind}>, ends array<bigint>, base int, "
    "lefts array<int>, rights array<int>, lengths array<bigint>, rounds array<int>, symbols array<int>"
)


#: The steps of a tokenizer under which plain pieces are cut here: NFC, blanks, lower case, then letters, digits and the rest apart.
PLAIN_STEPS = (
    [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}],
    [
        {
            "type": "Split", "behavior": "Removed", "invert": True,
            "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"},
        },
        {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
    ],
)
#: Letters beyond ASCII in plain pieces: NFC leaves them alone, and in lower case they are one letter of these again.
LETTERS = "".join(c for c in map(chr, range(0xC0, 0x180)) if c not in "\xd7\xf7\u0130")
RUNS = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[a-z{LETTERS}]+|[0-9]|[^\sa-z0-9{LETTERS}]+")


class _Remembered(dict):
    """Bytes by text, made when first asked for; those of the generation before are taken over."""

    def __init__(self, make: Callable[[str], bytes], older: dict[str, bytes], most: int):
        self._make, self._older, self._most = make, older, most

    def __missing__(self, text: str) -> bytes:
        found = self._older.get(text)
        if found is None:
            found = self._make(text)
        if len(text) <= LONGEST_PIECE:
            self[text] = found
        return found

    def next(self) -> _Remembered:
        """This one, or a fresh one after it if it is full."""
        return self if len(self) <= self._most else _Remembered(self._make, dict(self), self._most)


class Encoder:
    """Ids of texts by the tokenizers library, remembered per piece.

    For tokenizers that never join anything across a space, tab or line feed, the ids of
    a text are those of its pieces between them, one after another; ``whole`` turns
    this off for tokenizers that do. Under the steps of :data:`PLAIN_STEPS` texts and pieces
    of ASCII and common Latin letters are cut into runs, of which fewer are different, and
    the library's model is asked for a run; other pieces go through all steps.
    """

    def __init__(self, model: str, whole: bool = False):
        from tokenizers import Tokenizer, pre_tokenizers

        self._tokenizer, self._whole = Tokenizer.from_str(model), whole
        told = json.loads(model)
        steps = tuple((told.get(n) or {}).get(k) for n, k in (("normalizer", "normalizers"), ("pre_tokenizer", "pretokenizers")))
        self._plain = None
        if steps == PLAIN_STEPS:
            level = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
            self._bytes = {ord(c): level.pre_tokenize_str(c)[0][0] for c in LETTERS}
            # what may hold an added token is not plain
            begin = "".join({c for t in told["added_tokens"] for c in t["content"][:1].lower() + t["content"][:1].upper()})
            plain = "".join(c for c in map(chr, range(0x21, 0x7F)) if c not in begin) + LETTERS
            self._plain = re.compile(rf"[ \n\t{re.escape(plain)}]*").fullmatch
        self._model = self._tokenizer.model
        self._runs = _Remembered(self._of_run, {}, MOST_RUNS)
        self._known = _Remembered(self._of_piece, {}, PIECES)

    def _ids(self, text: str) -> np.ndarray:
        return np.array(self._tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, np.int32)

    def _of_run(self, run: str) -> bytes:
        return array("i", [t.id for t in self._model.tokenize(run if run.isascii() else run.translate(self._bytes))]).tobytes()

    def _of_plain(self, text: str) -> bytes:
        return b"".join(map(self._runs.__getitem__, RUNS.findall(text.lower())))

    def _of_piece(self, piece: str) -> bytes:
        return self._of_plain(piece) if self._plain and self._plain(piece) else self._ids(piece).tobytes()

    def _of_text(self, text: str) -> bytes:
        self._known, self._runs = self._known.next(), self._runs.next()
        if self._plain and self._plain(text):
            return self._of_plain(text)
        return b"".join(map(self._known.__getitem__, text.replace("\n", " ").replace("\t", " ").split(" ")))

    def __call__(self, texts: list[str | None]) -> list[np.ndarray]:
        if self._whole:
            return [self._ids(t or "") for t in texts]
        return [np.frombuffer(self._of_text(t or ""), np.int32) for t in texts]


@lru_cache(maxsize=1)
def encoder(model: str, whole: bool = False) -> Encoder:
    """The encoder of a Python worker: tasks that run in it one after another share what it remembers."""
    return Encoder(model, whole)


def compress(ids: np.ndarray, base: int) -> dict:
    """A grammar for ``ids``: rules (lefts, rights) of symbols from ``base`` on, the length that each
    expands to, the number of rules after each round, and the symbols left.

    A round counts all neighbouring pairs and replaces frequent ones by new symbols, most
    frequent first. Pairs of one round do not share a symbol on opposite sides, so their
    places never overlap; in runs of one id every second place counts.
    """
    symbols = ids.astype(np.int32)
    lefts, rights, rounds = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], []
    rules = 0
    while len(symbols) > 1:
        # a bucket holds at least what each of its pairs holds, so rare buckets have no frequent pair
        bucket = _buckets(symbols[:-1], symbols[1:])
        held = np.bincount(bucket, minlength=BUCKET + 1)
        least = max(LEAST_PAIRS, int(held.max() * ROUND_SHARE))
        place = np.flatnonzero((held >= least)[bucket])
        keys = (symbols[place].astype(np.int64) << 32) | symbols[place + 1]
        pairs, counts = np.unique(keys, return_counts=True)
        counts = np.where(pairs >> 32 == pairs & 0xFFFFFFFF, (counts + 1) // 2, counts)
        if not (counts >= least).any():
            if least == LEAST_PAIRS:
                break
            least = max(LEAST_PAIRS, int(counts.max(initial=0) * ROUND_SHARE))
        at = np.flatnonzero(counts >= least)
        at = at[np.argsort(-counts[at], kind="stable")]
        sides = bytearray(base + rules)  # 1: a left side, 2: a right side, 3: both
        chosen = []
        for a, b, key in zip((pairs[at] >> 32).tolist(), (pairs[at] & 0xFFFFFFFF).tolist(), pairs[at].tolist()):
            if a == b:
                if sides[a]:
                    continue
                sides[a] = 3
            elif sides[a] & 2 or sides[b] & 1:
                continue
            else:
                sides[a], sides[b] = 1, 2
            chosen.append(key)
        if not chosen:
            break
        chosen = np.array(chosen, np.int64)
        number = _numbers(keys, bucket[place], chosen)
        hit = number >= 0
        runs = chosen[chosen >> 32 == chosen & 0xFFFFFFFF]
        if len(runs):  # runs of one id
            same = np.flatnonzero(hit & (keys >> 32 == keys & 0xFFFFFFFF))
            fresh = np.diff(place[same], prepend=-2) != 1
            begin = place[same][fresh][np.cumsum(fresh) - 1]
            hit[same[(place[same] - begin) % 2 == 1]] = False
        where = place[hit]
        symbols[where] = base + rules + number[hit]
        stays = np.ones(len(symbols), bool)
        stays[where + 1] = False
        symbols = symbols[stays]
        lefts.append(chosen >> 32)
        rights.append(chosen & 0xFFFFFFFF)
        rules += len(chosen)
        rounds.append(rules)
    left, right = np.concatenate(lefts), np.concatenate(rights)
    lengths = np.zeros(rules, np.int64)
    for start, end in zip([0, *rounds], rounds):
        lengths[start:end] = _lengths(left[start:end], base, lengths) + _lengths(right[start:end], base, lengths)
    return {"base": base, "lefts": left, "rights": right, "lengths": lengths, "rounds": rounds, "symbols": symbols}


def _buckets(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Bucket of each pair."""
    mixed = left.astype(np.uint32) * np.uint32(0x9E3779B1)
    mixed += right.astype(np.uint32) * np.uint32(0x85EBCA77)
    mixed &= np.uint32(BUCKET)
    return mixed.astype(np.intp)


def _numbers(keys: np.ndarray, bucket: np.ndarray, chosen: np.ndarray) -> np.ndarray:
    """Number of each key among the chosen ones, -1 for others: looked up by bucket, and by
    a search for those chosen whose bucket another one has."""
    own = _buckets(chosen >> 32, chosen & 0xFFFFFFFF)
    slot = np.full(BUCKET + 1, -1, np.int32)
    slot[own] = np.arange(len(chosen), dtype=np.int32)
    number = slot[bucket]
    found = np.flatnonzero(number >= 0)
    wrong = found[chosen[number[found]] != keys[found]]
    number[wrong] = -1
    apart = np.flatnonzero(slot[own] != np.arange(len(chosen)))
    if len(apart) and len(wrong):
        apart = apart[np.argsort(chosen[apart])]
        near = np.minimum(np.searchsorted(chosen[apart], keys[wrong]), len(apart) - 1)
        right = chosen[apart][near] == keys[wrong]
        number[wrong[right]] = apart[near[right]]
    return number


def _lengths(symbols: np.ndarray, base: int, lengths: np.ndarray) -> np.ndarray:
    """Number of ids behind each symbol."""
    out = np.ones(len(symbols), np.int64)
    rule = symbols >= base
    out[rule] = lengths[symbols[rule] - base]
    return out


def _joined(begin: np.ndarray, size: np.ndarray, flat: np.ndarray) -> np.ndarray:
    """The pieces of ``flat`` that begin and are as long as told, one after another."""
    ends = np.cumsum(size)
    at = np.repeat(begin - (ends - size), size)
    at += np.arange(len(at))
    return flat[at]


def _spelled(shard: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Where the ids of each symbol begin, how many there are, and all of them: single ids, then
    those of the rules, round by round."""
    base, rules = shard["base"], np.asarray(shard["lengths"], np.int64)
    size = np.append(np.ones(base, np.int64), rules)
    begin = np.cumsum(size) - size
    flat = np.arange(base + int(rules.sum()), dtype=np.int32)
    for start, end in zip([0, *shard["rounds"]], shard["rounds"]):
        both = np.stack([shard["lefts"][start:end], shard["rights"][start:end]], 1).ravel()
        made = _joined(begin[both], size[both], flat)
        flat[begin[base + start] : begin[base + start] + len(made)] = made
    return begin, size, flat


def expand(symbols: np.ndarray, shard: dict) -> np.ndarray:
    """The ids behind symbols; what each rule stands for is spelled out once for a shard."""
    if "spelled" not in shard:
        shard["spelled"] = _spelled(shard)
    begin, size, flat = shard["spelled"]
    return _joined(begin[symbols], size[symbols], flat)


def read_slice(shard: dict, start: int, end: int) -> np.ndarray:
    """Ids ``start`` to ``end`` of a shard, by random access: only symbols that reach into the
    slice are looked at, and expansion lengths say which half of a rule to enter."""
    base, lengths, lefts, rights = shard["base"], shard["lengths"], shard["lefts"], shard["rights"]
    if "bounds" not in shard:
        shard["bounds"] = np.cumsum(_lengths(shard["symbols"], base, lengths))
    bounds = shard["bounds"]
    first, last = int(np.searchsorted(bounds, start, side="right")), int(np.searchsorted(bounds, end, side="left"))
    symbols = [int(s) for s in shard["symbols"][first : last + 1]]
    skip = start - (int(bounds[first - 1]) if first else 0)
    # cut the outer symbols down along their rules, then expand what is left
    while symbols and symbols[0] >= base and skip:
        rule = symbols[0] - base
        left = int(lefts[rule])
        size = int(lengths[left - base]) if left >= base else 1
        if skip >= size:
            symbols[0], skip = int(rights[rule]), skip - size
        else:
            symbols[:1] = [left, int(rights[rule])]
    return expand(np.array(symbols, np.int64), shard)[skip : skip + end - start]


def _shard(part: int, number: int, docs: list[pa.Array], rows: list[np.ndarray], base: int) -> pa.RecordBatch:
    ids = pa.concat_arrays(docs)
    made = compress(np.concatenate(rows), base)

    def one(values) -> pa.ListArray:
        return pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)

    ends = np.cumsum([len(r) for r in rows])
    columns = {
        "part": pa.array([part], pa.int32()),
        "number": pa.array([number], pa.int32()),
        "tokens": pa.array([int(ends[-1])], pa.int64()),
        "first": ids[:1],
        "last": ids[len(ids) - 1 :],
        "docs": one(ids),
        "ends": one(pa.array(ends, pa.int64())),
        "base": pa.array([base], pa.int32()),
        **{n: one(pa.array(np.asarray(made[n]).astype(np.int32))) for n in ("lefts", "rights")},
        "lengths": one(pa.array(made["lengths"])),
        "rounds": one(pa.array(made["rounds"], pa.int32())),
        "symbols": one(pa.array(made["symbols"].astype(np.int32))),
    }
    return pa.RecordBatch.from_arrays(list(columns.values()), list(columns))


def write_tokens(
    docs: DataFrame, path: str, tokenizer: str, end_id: int = 1, key: str = "doc_id", text: str = "text",
    shard_tokens: int = SHARD_TOKENS, whole: bool = False,
) -> None:
    """Write the ids of all texts below ``path``, documents in ascending order of ``key``.

    ``tokenizer`` is a file of the tokenizers library; its content is broadcast (a
    vocabulary does not grow with the documents). Texts are dealt by ranges of the key,
    encoded and compressed in the task that writes them. A file's row is a shard: whole
    documents of about ``shard_tokens`` ids, with ``docs`` and ``ends`` (where each ends),
    the rules of its grammar with their expansion lengths, and the remaining symbols.

    * Null and empty texts: the end id alone. Null keys: last. Repeated keys: by a digest
      of the text, so that reruns agree. A long text makes its shard longer.
    * Empty table: files without rows. Other columns are not written.
    """
    from tokenizers import Tokenizer

    with open(tokenizer, encoding="utf-8") as f:
        model = f.read()
    base = max(end_id, *Tokenizer.from_str(model).get_vocab().values()) + 1
    kind = dict(docs.dtypes)[key]
    shared = docs.sparkSession.sparkContext.broadcast(model)
    size = docs.agg(F.sum(F.octet_length(text).cast("long"))).first()[0] or 0
    order = [F.col("key_").asc_nulls_last(), F.col("tie_")]
    rows = docs.select(F.col(key).alias("key_"), F.col(text).alias("text_"), F.xxhash64(text).alias("tie_"))
    dealt = rows.repartitionByRange(max(1, ceil(size / TASK_BYTES)), *order).sortWithinPartitions(*order)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, number, held, ids, total, part = encoder(shared.value, whole), 0, [], [], 0, 0
        for batch in slices(batches, 128):
            part = batch.column("part")[0].as_py() if batch.num_rows else part
            found = encode(batch.column("text_").to_pylist())
            start = 0
            for i, row in enumerate(found):
                ids.append(np.append(row, np.int32(end_id)))
                total += len(row) + 1
                if total >= shard_tokens:
                    held.append(batch.column("key_").slice(start, i + 1 - start))
                    yield _shard(part, number, held, ids, base)
                    number, held, ids, total, start = number + 1, [], [], 0, i + 1
            if start < len(found):
                held.append(batch.column("key_").slice(start))
        if ids:
            yield _shard(part, number, held, ids, base)

    numbered = dealt.select("key_", "text_", F.spark_partition_id().alias("part"))
    numbered.mapInArrow(run, _FORMAT.format(kind=kind)).write.parquet(path)


def _loaded(batch: pa.RecordBatch) -> Iterator[tuple[dict, pa.Array, np.ndarray]]:
    """Shards of a batch with their documents and ends."""
    arrays = ("lefts", "rights", "lengths", "rounds", "symbols", "ends")
    for i in range(batch.num_rows):
        shard = {n: batch.column(n)[i].values.to_numpy(zero_copy_only=False) for n in arrays}
        shard["base"] = batch.column("base")[i].as_py()
        shard["rounds"] = shard["rounds"].tolist()
        yield shard, batch.column("docs")[i].values, shard.pop("ends")


def shard_starts(shards: DataFrame) -> DataFrame:
    """(part, number, start_): ids before every shard, from sums per writing task and then within it."""
    sums = shards.groupBy("part").agg(F.sum("tokens").alias("tokens"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    inside = Window.partitionBy("part").orderBy("number").rowsBetween(Window.unboundedPreceding, -1)
    parts = sums.select("part", F.coalesce(F.sum("tokens").over(before), F.lit(0)).alias("before_"))
    own = shards.select("part", "number", F.coalesce(F.sum("tokens").over(inside), F.lit(0)).alias("inside_"))
    return own.join(parts, "part").select("part", "number", (F.col("before_") + F.col("inside_")).alias("start_"))


def read_tokens(spark: SparkSession, path: str, key: str = "doc_id", ids: bool = True) -> DataFrame:
    """(key, start, n_tokens, ids_crc32, ids) of all documents, decoded from the files.

    ``start`` counts the ids of all documents before; ``ids_crc32`` is the checksum of the
    ids as little-endian unsigned 32-bit numbers. ``ids=False`` leaves the ids out.
    """
    shards = spark.read.parquet(path)
    kind = dict(shards.dtypes)["first"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1):
            for shard, docs, ends in _loaded(batch):
                every = expand(shard["symbols"], shard).astype("<u4")
                starts = np.append(0, ends[:-1])
                sums = [crc32(every[a:b]) for a, b in zip(starts, ends)]
                columns = {
                    "part": pa.array(np.full(len(docs), batch.column("part")[0].as_py(), np.int32)),
                    "number": pa.array(np.full(len(docs), batch.column("number")[0].as_py(), np.int32)),
                    "doc": docs,
                    "offset": pa.array(starts, pa.int64()),
                    "n_tokens": pa.array(ends - starts, pa.int64()),
                    "ids_crc32": pa.array(sums, pa.int64()),
                }
                if ids:
                    at = pa.array(np.append(0, ends), pa.int32())
                    columns["ids"] = pa.ListArray.from_arrays(at, pa.array(every.astype(np.int32)))
                yield pa.RecordBatch.from_arrays(list(columns.values()), list(columns))

    shape = f"part int, number int, doc {kind}, offset bigint, n_tokens bigint, ids_crc32 bigint" + (", ids array<int>" if ids else "")
    decoded = shards.mapInArrow(run, shape).join(shard_starts(shards.select("part", "number", "tokens")), ["part", "number"])
    start = (F.col("start_") + F.col("offset")).alias("start")
    return decoded.select(F.col("doc").alias(key), start, "n_tokens", "ids_crc32", *(["ids"] if ids else []))


def fetch_tokens(spark: SparkSession, path: str, keys: list, key: str = "doc_id") -> DataFrame:
    """(key, ids) of the documents named: shards without them are skipped by the bounds in
    their rows, the others give only the slices asked for. Unknown keys: no rows."""
    shards = spark.read.parquet(path)
    kind = dict(shards.dtypes)["first"]
    known = [k for k in keys if k is not None]
    inside = F.lit(False)
    for k in known:
        inside = inside | ((F.col("first") <= F.lit(k)) & (F.coalesce(F.col("last") >= F.lit(k), F.lit(True))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1):
            for shard, docs, ends in _loaded(batch):
                names = docs.to_pylist()
                at = [i for i, name in enumerate(names) if name in known]
                rows = [read_slice(shard, int(ends[i - 1]) if i else 0, int(ends[i])) for i in at]
                columns = [docs.take(pa.array(at, pa.int64())), pa.array(rows, pa.list_(pa.int32()))]
                yield pa.RecordBatch.from_arrays(columns, ["doc", "ids"])

    return shards.filter(inside).mapInArrow(run, f"doc {kind}, ids array<int>").withColumnRenamed("doc", key)
