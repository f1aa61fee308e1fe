"""Packing token sequences by a grouping genetic algorithm.

Texts become token pieces of at most `size` ids; a piece of exactly that many is
a sequence.  The others are dealt evenly to shards of bounded size, and each
shard has islands, rows of a table that hold a population of packings.  First
parents are best-fit decreasing and packings that fill bin after bin by subset
sums over sizes in random order, so they differ.  An epoch is one Spark job over
all islands: crossover takes well-filled bins of one parent whole into the
other, bins there that hold the same pieces are dissolved, the emptiest ones are
opened, and the loose pieces are fitted in again, by best fit or by subset sums.
Between epochs each island's best packing moves to the shard's next island, by
a shuffle.  An island at the least possible number of bins has nothing to gain
and rests.  Fitness is the number of bins, then the mean square of their fill.
The emptiest bins of each shard are dissolved at the end, and those pieces of
many shards are packed together in the same way.

Ids: a chunk between white space is tokenised alone, since the tokenizer's words
never reach over it; distinct chunks are kept in a bounded table, and new ones
go through the tokenizer together, told apart by their last ids or by a control
character between them.  Chunks whose answer does not fit that go one by one,
and texts with the tokenizer's special tokens as they are.
"""

from __future__ import annotations

import re
import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sequora.llm import kernel as K
from sequora.llm.runtime import Tables, lean, picked, ship

SIZE = 2048
_MARK = "\x07"
#: A word of Latin-1 letters, and a sign: normalisation leaves it alone but for its case.
_PLAIN = re.compile(r"([A-Za-zÀ-ÖØ-öø-ÿ]+)([.,]?)\Z")


class Encoder:
    """Ids of texts by a tokenizer file, through tables of chunks seen before.

    Most chunks are a word of Latin-1 letters with a full stop or comma or neither.  The tokenizer lower-cases, and a run of
    letters and a sign after it are words of their own to it, so such a chunk is its lower-case word's ids and the sign's id.
    """

    def __init__(self, path: str, most: int = 300_000):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.special = [t.content.encode() for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.most = most
        self.mark = self.tokenizer.encode(_MARK, add_special_tokens=False).ids
        self.ends_word = np.zeros(self.tokenizer.get_vocab_size(), bool)
        self.ends_word[[i for t, i in self.tokenizer.get_vocab().items() if t.endswith("</w>")]] = True
        self.signs = [self.tokenizer.encode(c, add_special_tokens=False).ids for c in ".,"]
        self.plain = [len(x) for x in self.signs] == [1, 1] and bool(self.ends_word.any())
        self.seen, self.seen_code = np.zeros(0, K.U64), np.zeros(0, np.int64)  # chunks by hash, sorted
        self.seen_len, self.seen_at, self.bytes = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint8)  # and their bytes, if over eight
        self.word: dict[str, int] = {"": 0}
        self.ids = np.zeros(0, np.uint32)
        self.cuts = np.zeros(2, np.int64)
        self.hits = np.zeros(1, np.int64)

    def whole(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, np.uint32)

    def forget(self) -> None:
        """Keep the words met more than once."""
        keep = np.flatnonzero(self.hits > 1)
        if 2 * len(keep) > self.most:
            keep = keep[:0]
        keep = np.union1d(keep, [0])
        lens = np.diff(self.cuts)[keep]
        place = np.cumsum(lens) - lens
        self.ids = self.ids[np.repeat(self.cuts[keep] - place, lens) + np.arange(int(lens.sum()))]
        self.cuts = np.append(place, lens.sum())
        names = list(self.word)
        self.word = {names[i]: n for n, i in enumerate(keep.tolist())}
        self.hits = np.ones(len(keep), np.int64)
        self.seen, self.seen_code = np.zeros(0, K.U64), np.zeros(0, np.int64)
        self.seen_len, self.seen_at, self.bytes = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint8)

    def learn(self, words: list[str], ended: bool) -> None:
        """New entries of the word table; `ended`: each is one word to the tokenizer, so its end shows in the ids."""
        got = None
        if ended:
            ids = np.array(self.tokenizer.encode_batch_fast([" ".join(words)], add_special_tokens=False)[0].ids, np.uint32)
            ends = np.flatnonzero(self.ends_word[ids]) + 1
            if len(ends) == len(words) and ends[-1] == len(ids):
                got = ids, np.diff(np.concatenate([[0], ends]))
        elif len(self.mark) == 1 and not any(_MARK in c for c in words):
            ids = np.array(self.tokenizer.encode_batch_fast([f" {_MARK} ".join(words)], add_special_tokens=False)[0].ids, np.uint32)
            ends = np.append(np.flatnonzero(ids == self.mark[0]), len(ids))
            if len(ends) == len(words):
                got = np.delete(ids, ends[:-1]), np.diff(np.concatenate([[-1], ends])) - 1
        if got is None:
            each = [self.whole(c) for c in words]
            got = np.concatenate(each), np.array([len(x) for x in each])
        self.word.update(zip(words, range(len(self.cuts) - 1, len(self.cuts) - 1 + len(words)), strict=True))
        self.ids = np.concatenate([self.ids, got[0]])
        self.cuts = np.concatenate([self.cuts, self.cuts[-1] + np.cumsum(got[1])])
        self.hits = np.concatenate([self.hits, np.zeros(len(words), np.int64)])

    def coded(self, chunks: list[str]) -> list[int]:
        """The code of each chunk, by the chunk itself."""
        have, match, sign_of = self.word, _PLAIN.match, {"": 0, ".": 1, ",": 2}
        split: list[tuple[str, int]] = []
        words: dict[str, None] = {}
        odd: dict[str, None] = {}
        for w in chunks:
            if self.plain and (m := match(w)):
                w, sign = m.groups()
                w = w.lower()
                split.append((w, sign_of[sign]))
                if w not in have:
                    words[w] = None
            else:
                split.append((w, 0))
                if w not in have:
                    odd[w] = None
        if words:
            self.learn(list(words), True)
        if odd:
            self.learn(list(odd), False)
        return [3 * have[w] + sign for w, sign in split]

    def codes(self, h: np.ndarray, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """A code for each chunk, given by hash and place: three times its word's number, plus 1 or 2 for the sign after it.

        Chunks of one hash are held against the bytes of the one that is known (up to eight bytes, length and hash say
        which they are); those that differ are looked up by themselves.
        """
        if len(self.seen) > 3 * self.most or len(self.word) > self.most:
            self.forget()
        lens = ends - starts
        unique, first, back = np.unique(h, return_index=True, return_inverse=True)
        at = np.searchsorted(self.seen, unique)
        known = at < len(self.seen)
        known[known] = self.seen[at[known]] == unique[known]
        raw = memoryview(data)
        code = np.empty(len(unique), np.int64)
        code[known] = self.seen_code[at[known]]
        old = np.flatnonzero(known)
        differ = old[differing(data, starts[first[old]], lens[first[old]], self.bytes, self.seen_at[at[old]], self.seen_len[at[old]])]
        new = np.flatnonzero(~known)
        asked = np.concatenate([new, differ])
        if len(asked):
            code[asked] = self.coded([str(raw[s:e], "utf-8") for s, e in zip(starts[first[asked]].tolist(), ends[first[asked]].tolist(), strict=True)])
        if len(new):
            n, s = np.where(lens[first[new]] > 8, lens[first[new]], 0), starts[first[new]]
            place = np.cumsum(n) - n
            step = np.arange(int(n.sum()))
            self.seen = np.insert(self.seen, at[new], unique[new])
            self.seen_code = np.insert(self.seen_code, at[new], code[new])
            self.seen_len = np.insert(self.seen_len, at[new], lens[first[new]])
            self.seen_at = np.insert(self.seen_at, at[new], len(self.bytes) + place)
            self.bytes = np.concatenate([self.bytes, data[np.repeat(s - place, n) + step]])
        out = code[back]
        other = differing(data, starts, lens, data, starts[first][back], lens[first][back])
        if len(other):
            out[other] = self.coded([str(raw[s:e], "utf-8") for s, e in zip(starts[other].tolist(), ends[other].tolist(), strict=True)])
        return out

    def encode(self, data: np.ndarray, offsets: np.ndarray, after: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Flat ids and offsets (n + 1) of the UTF-8 texts between offsets, each followed by `after` if given."""
        h, starts, ends, first = K.words(data, offsets)
        lo = int(offsets[0])
        code = self.codes(h, data[lo : int(offsets[-1])], starts - lo, ends - lo)
        word, sign = np.divmod(code, 3)
        self.hits += np.bincount(word, minlength=len(self.hits))
        begin, bare = self.cuts[word], np.diff(self.cuts)[word]
        lens = bare + (sign > 0)
        place = np.cumsum(lens) - lens
        ids = np.empty(int(lens.sum()), np.uint32)
        step = np.arange(int(bare.sum())) - np.repeat(np.cumsum(bare) - bare, bare)
        ids[np.repeat(place, bare) + step] = self.ids[np.repeat(begin, bare) + step]
        for n, x in enumerate(self.signs, 1):
            at = sign == n
            if at.any():
                ids[place[at] + bare[at]] = x[0]
        cuts = np.append(place, lens.sum())[first]
        texts = [bytes(data[a:b]) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
        odd = [i for i, t in enumerate(texts) if any(s in t for s in self.special)]
        if odd:
            parts = [ids[a:b] for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)]
            for i in odd:
                parts[i] = self.whole(texts[i].decode())
            ids, cuts = np.concatenate(parts), np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int64)
        return (ids, cuts) if after is None else (np.insert(ids, cuts[1:], after), cuts + np.arange(len(cuts)))


def differing(a: np.ndarray, at_a: np.ndarray, len_a: np.ndarray, b: np.ndarray, at_b: np.ndarray, len_b: np.ndarray) -> np.ndarray:
    """Which stretches of a differ from those of b (equal hashes given, so those of up to eight bytes only by length)."""
    differ = len_a != len_b
    long = np.flatnonzero(~differ & (len_a > 8))
    n = len_a[long]
    inner = np.cumsum(n) - n
    step = np.arange(int(n.sum()))
    wrong = a[np.repeat(at_a[long] - inner, n) + step] != b[np.repeat(at_b[long] - inner, n) + step]
    if wrong.any():
        differ[long[np.add.reduceat(wrong, inner) > 0]] = True
    return np.flatnonzero(differ)


_ENCODERS: dict[str, Encoder] = {}


@lean
def _pieces(batches: Iterator[pa.RecordBatch], path: str, size: int, after: int) -> Iterator[pa.RecordBatch]:
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    encoder = _ENCODERS[path]
    for batch in batches:
        data, offsets = K.string_buffers(batch.column("text"))
        for i, j in K.slices(offsets, 1 << 20):
            ids, cuts = encoder.encode(data, offsets[i : j + 1], after)
            raw = memoryview(ids.astype("<u4").tobytes())
            lens = np.diff(cuts)
            n = -(-lens // size)
            row = np.repeat(np.arange(j - i), n)
            piece = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
            start = piece * size
            length = np.minimum(lens[row] - start, size)
            at = (cuts[row] + start).tolist()
            crc = [zlib.crc32(raw[4 * a : 4 * (a + x)]) for a, x in zip(at, length.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(i, j - i).take(pa.array(row)), pa.array(piece.astype(np.int32)), pa.array(start), pa.array(length), pa.array(crc, pa.int64())], ["doc_id", "piece", "start", "length", "ids_crc32"])


def best_fit(sizes: list[int], items: list[int], bin_of: np.ndarray, free: list[int], capacity: int) -> None:
    """Put items, in this order, where least room stays; bin_of and free (the room of each bin) change."""
    room = sorted((f, b) for b, f in enumerate(free) if f > 0)
    for x in items:
        s = sizes[x]
        i = bisect_left(room, (s, -1))
        if i == len(room):
            f, b = capacity, len(free)
            free.append(capacity)
        else:
            f, b = room.pop(i)
        bin_of[x] = b
        free[b] = f - s
        if f > s:
            insort(room, (f - s, b))


def decreasing(sizes: np.ndarray, capacity: int) -> np.ndarray:
    """Best-fit decreasing: the bin of each piece."""
    bin_of = np.empty(len(sizes), np.int64)
    best_fit(sizes.tolist(), np.argsort(-sizes, kind="stable").tolist(), bin_of, [], capacity)
    return bin_of


def filled(sizes: np.ndarray, capacity: int, rng: np.random.Generator, copies: int = 4) -> np.ndarray:
    """Bin after bin, the largest piece left and, of those that fit beside it, a set with the largest sum found over sizes in random order (of each size at most `copies`)."""
    left: dict[int, list[int]] = {}
    for i, s in enumerate(sizes.tolist()):
        left.setdefault(s, []).append(i)
    names = sorted(left)
    bin_of = np.empty(len(sizes), np.int64)
    n = 0

    def use(s: int) -> None:
        bin_of[left[s].pop()] = n
        if not left[s]:
            del left[s]
            del names[bisect_left(names, s)]

    while names:
        room = capacity - names[-1]
        use(names[-1])
        reach, steps, within = 1, [], (1 << (room + 1)) - 1  # bit i: a sum of i is reached
        for j in rng.permutation(bisect_left(names, room + 1)).tolist():
            s = names[j]
            for _ in range(min(len(left[s]), copies)):
                more = (reach | reach << s) & within
                if more == reach:
                    break
                steps.append((s, reach))
                reach = more
            if reach >> room:
                break
        total = reach.bit_length() - 1
        for s, before in reversed(steps):
            if not before >> total & 1:
                use(s)
                total -= s
        n += 1
    return bin_of


def fitness(bin_of: np.ndarray, sizes: np.ndarray, capacity: int) -> tuple[int, float]:
    """Fewer bins, then fuller ones, are better."""
    fill = np.bincount(bin_of, sizes)
    return -len(fill), float(np.mean((fill / capacity) ** 2)) if len(fill) else 1.0


def crossover(a: np.ndarray, b: np.ndarray, sizes: np.ndarray, capacity: int, rng: np.random.Generator) -> np.ndarray:
    """Well-filled bins of b go whole into a; bins of a that held their pieces, and some of the emptiest, are opened; loose pieces are fitted in again."""
    fill_a, fill_b = np.bincount(a, sizes), np.bincount(b, sizes)
    good = np.argsort(-fill_b, kind="stable")[: max(1, len(fill_b) // 2)]
    chosen = np.zeros(len(fill_b), bool)
    chosen[rng.choice(good, max(1, int(len(good) * rng.uniform(0.05, 0.6))), replace=False)] = True
    injected = chosen[b]
    opened = np.zeros(len(fill_a), bool)
    opened[a[injected]] = True
    emptiest = np.argsort(fill_a, kind="stable")[: max(2, len(fill_a) // 20)]
    opened[rng.choice(emptiest, -(-len(emptiest) // 2), replace=False)] = True
    loose = np.flatnonzero(opened[a] & ~injected)
    out = np.where(injected, b + len(fill_a), a)
    held = np.ones(len(a), bool)
    held[loose] = False
    names, out[held] = np.unique(out[held], return_inverse=True)
    if rng.random() < 0.5:
        out[loose] = len(names) + filled(sizes[loose], capacity, rng)
    else:
        free = (capacity - np.bincount(out[held], sizes[held], len(names))).astype(np.int64).tolist()
        best_fit(sizes.tolist(), loose[np.argsort(-sizes[loose], kind="stable")].tolist(), out, free, capacity)
    return out


def parents(sizes: np.ndarray, capacity: int, rng: np.random.Generator, population: int) -> list[np.ndarray]:
    """Different packings of one shard; best-fit decreasing alone where it has the least possible number of bins."""
    first = decreasing(sizes, capacity)
    least = -(-int(sizes.sum()) // capacity)
    return [first] if -fitness(first, sizes, capacity)[0] <= least else [first, *(filled(sizes, capacity, rng) for _ in range(population - 1))]


def evolve(pool: list[np.ndarray], sizes: np.ndarray, capacity: int, rng: np.random.Generator, generations: int) -> list[np.ndarray]:
    """The pool, best first, after so many crossovers; it ends early at the least possible number of bins."""
    least = -(-int(sizes.sum()) // capacity)
    ranked = sorted(((fitness(x, sizes, capacity), i, x) for i, x in enumerate(pool)), reverse=True)
    for i in range(generations):
        if -ranked[0][0][0] <= least or len(ranked) < 2:
            break
        a, b = rng.choice(len(ranked), 2, replace=False)
        child = crossover(ranked[a][2], ranked[b][2], sizes, capacity, rng)
        found = fitness(child, sizes, capacity)
        if found > ranked[-1][0] and all(found != x[0] for x in ranked):
            ranked[-1] = found, len(pool) + i, child
            ranked.sort(reverse=True)
    return [x for _, _, x in ranked]


_ISLANDS = "shard long, island int, sizes binary, pool binary, best binary, least int, first int, bins int, fitness double, done boolean"


@lean
def _epoch(batches: Iterator[pa.RecordBatch], capacity: int, population: int, generations: int, epoch: int) -> Iterator[pa.RecordBatch]:
    """Islands after an epoch; in the first one (0) they get their parents.  `first` is the number of bins of best-fit decreasing."""
    for batch in batches:
        for row in batch.to_pylist():
            sizes = np.frombuffer(row["sizes"], "<u4").astype(np.int64)
            rng = np.random.default_rng([abs(row["shard"]), row["island"], epoch])
            if epoch == 0:
                pool = parents(sizes, capacity, rng, population)
                row["first"] = -fitness(pool[0], sizes, capacity)[0]
            else:
                pool = [*np.frombuffer(row["pool"], "<u4").astype(np.int64).reshape(-1, max(1, len(sizes)))]
                if not row["done"]:
                    pool[-1] = np.frombuffer(row["migrant"], "<u4").astype(np.int64)
            if epoch == 0 or not row["done"]:
                pool = evolve(pool, sizes, capacity, rng, generations if epoch else 0)
            least = -(-int(sizes.sum()) // capacity)
            bins, mean = fitness(pool[0], sizes, capacity)
            out = {k: row[k] for k in ("shard", "island", "sizes", "first")}
            out |= {"pool": np.concatenate(pool).astype("<u4").tobytes(), "best": pool[0].astype("<u4").tobytes(), "least": least, "bins": -bins, "fitness": mean, "done": -bins <= least}
            names = [x.split()[0] for x in _ISLANDS.split(", ")]
            types = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary(), "double": pa.float64(), "boolean": pa.bool_()}
            yield pa.RecordBatch.from_arrays([pa.array([out[n]], types[x.split()[1]]) for n, x in zip(names, _ISLANDS.split(", "), strict=True)], names)


@lean
def _places(batches: Iterator[pa.RecordBatch], capacity: int, keep: float, opened: int) -> Iterator[pa.RecordBatch]:
    """Row, sequence and offset of each piece of packed shards; loose: in one of the emptiest bins, an `opened`-th of all (one at least), if filled less than `keep`."""
    for batch in batches:
        for i in range(batch.num_rows):
            shard, bin_of = batch.column("shard")[i].as_py(), np.frombuffer(batch.column("best")[i].as_py(), "<u4").astype(np.int64)
            sizes = np.frombuffer(batch.column("sizes")[i].as_py(), "<u4").astype(np.int64)
            fill = np.bincount(bin_of, sizes)
            loose = np.zeros(len(fill), bool)
            loose[np.argsort(fill, kind="stable")[: max(1, len(fill) // opened)]] = True
            loose &= fill < keep * capacity
            order = np.argsort(bin_of, kind="stable")
            b, n = bin_of[order], sizes[order]
            run = np.cumsum(n) - n
            begin = np.searchsorted(b, np.arange(len(fill)))
            rows = batch.column("rows")[i].values.take(pa.array(order))
            yield pa.RecordBatch.from_arrays([rows, pa.array(n), pa.array(b + (shard << 24)), pa.array(run - run[begin][b]), pa.array(loose[b])], ["row", "length", "sequence_id", "offset", "loose"])


def islands(pieces: DataFrame, spark: SparkSession, shards: int, size: int, islands: int, population: int, epochs: int, generations: int, at: int = 0) -> tuple[DataFrame, Tables]:
    """The best packing of each shard of pieces (row, length): shard (numbered from `at`), rows, sizes, best (the bin of each row), least, first, bins."""
    tables = Tables(spark)
    shard = F.pmod(F.xxhash64("row"), F.lit(shards)) + at
    listed = pieces.groupBy(shard.alias("shard")).agg(F.sort_array(F.collect_list(F.struct("length", "row")), False).alias("p"))
    listed = tables.write(listed.select("shard", F.col("p.row").alias("rows"), F.col("p.length").alias("lengths")))
    run = partial(_epoch, capacity=size, population=population, generations=generations)
    start = listed.select("shard", F.explode(F.array(*map(F.lit, range(islands)))).alias("island"), "lengths").repartition(max(1, min(islands * shards, 4096)), "shard", "island")
    now = tables.write(start.mapInArrow(_sized, "shard long, island int, sizes binary").mapInArrow(partial(run, epoch=0), _ISLANDS))
    for epoch in range(1, epochs + 1):
        if not now.where("not done").take(1):
            break
        elite = now.select(F.col("shard").alias("shard_"), ((F.col("island") + 1) % islands).alias("island_"), F.col("best").alias("migrant"))
        met = now.join(elite, (F.col("shard") == F.col("shard_")) & (F.col("island") == F.col("island_"))).drop("shard_", "island_")
        past, now = now, tables.write(met.mapInArrow(partial(run, epoch=epoch), _ISLANDS))
        tables.drop(past)
    best = now.groupBy("shard").agg(F.max(F.struct(-F.col("bins"), "fitness", -F.col("island"), "best", "sizes", "least", "first", "bins")).alias("r"))
    return listed.drop("lengths").join(best.select(F.col("shard").alias("shard_"), "r.best", "r.sizes", "r.least", "r.first", "r.bins"), F.col("shard") == F.col("shard_")).drop("shard_"), tables


@lean
def _sized(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sizes = [x.values.to_numpy(zero_copy_only=False).astype("<u4").tobytes() for x in batch.column("lengths")]
        yield pa.RecordBatch.from_arrays([batch.column("shard"), batch.column("island"), pa.array(sizes, pa.binary())], ["shard", "island", "sizes"])


def pack(pieces: DataFrame, spark: SparkSession, size: int = SIZE, shard_pieces: int = 8192, keep: float = 0.99, opened: int = 64, **options: int) -> DataFrame:
    """pieces (doc_id, piece, start, length, ids_crc32) with sequence_id and offset; options: islands, population, epochs, generations."""
    columns = ["doc_id", "piece", "start", "length", "ids_crc32"]
    tables = Tables(spark)
    pieces = tables.write(pieces.select(*columns, F.monotonically_increasing_id().alias("row")))
    short = pieces.where(F.col("length") < size).select("row", "length")
    options = {"islands": 3, "population": 4, "epochs": 3, "generations": 12} | options
    shards = max(1, -(-short.count() // shard_pieces))
    places = "row long, length long, sequence_id long, offset long, loose boolean"
    best, used = islands(short, spark, shards, size, **options)
    first = tables.write(best.mapInArrow(partial(_places, capacity=size, keep=keep, opened=opened), places))
    used.drop(*[t for _, t in list(used.paths.values())])
    # what is in the emptiest bins of `opened` shards is packed together; those shards have numbers of their own
    best, _ = islands(first.where("loose").select("row", "length"), spark, -(-shards // opened), size, at=shards, **options)
    rest = best.mapInArrow(partial(_places, capacity=size, keep=0.0, opened=opened), places)
    placed = first.where("not loose").unionByName(rest).select(F.col("row").alias("row_"), "sequence_id", "offset")
    whole = pieces.where(F.col("length") >= size).select(*columns, (-1 - F.col("row")).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    return pieces.where(F.col("length") < size).join(placed, F.col("row") == F.col("row_")).select(*columns, "sequence_id", "offset").unionByName(whole)


def gains(pieces: DataFrame, spark: SparkSession, size: int = SIZE, shard_pieces: int = 8192, **options: int) -> DataFrame:
    """Per shard of pieces (length, any others): pieces, least (possible bins), first (those of best-fit decreasing) and bins (those of evolution)."""
    rows = Tables(spark).write(pieces.where(F.col("length") < size).select(F.monotonically_increasing_id().alias("row"), "length"))
    options = {"islands": 3, "population": 4, "epochs": 3, "generations": 12} | options
    best, _ = islands(rows, spark, max(1, -(-rows.count() // shard_pieces)), size, **options)
    return best.select("shard", F.size("rows").alias("pieces"), "least", "first", "bins")


def token_pieces(docs: DataFrame, spark: SparkSession, tokenizer: str, size: int = SIZE, after: int = 0) -> DataFrame:
    """Per piece of at most `size` ids: doc_id, piece, start, length, ids_crc32; a text's ids end with `after`."""
    ship(spark)
    base = picked(docs, doc_id="long", text="string")
    return base.mapInArrow(partial(_pieces, path=tokenizer, size=size, after=after), "doc_id long, piece int, start long, length long, ids_crc32 long")


def pack_documents(docs: DataFrame, spark: SparkSession, tokenizer: str, size: int = SIZE, after: int = 0, **options: object) -> DataFrame:
    """Per piece of docs' texts: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    Null and empty texts are the one id `after`.  Longer texts than `size` ids are cut into pieces of `size`, the last
    may be shorter; nothing else is cut.  Repeated rows and null ids are packed like others; an empty table gives an empty one.
    """
    return pack(token_pieces(docs, spark, tokenizer, size, after), spark, size, **options)
