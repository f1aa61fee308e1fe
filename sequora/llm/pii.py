"""Personal data by bootstrapped contextual extraction.

Base entities (e-mail, IP, card, phone) are found by fixed patterns and seed the
bootstrap.  Occurrences are these seeds and all candidates: other tokens with
enough digits or an at sign (@, [at], (at)), groups of digits joined by spaces
and signs, and, of a run of digits too long for one number, the stretches from
its start and to its end (a plus sign starts another run).  An occurrence has five contexts:
the token before it with its shape, its shape with the token after it, its shape
with the lengths of its runs of digits, and the tokens before and after it, each
with its coarse form (an address, or a number of so many digits).  Contexts and
identifiers form a graph with an edge wherever they occur together.  Rounds on
that graph in Spark: a context's confidence is the share of its identifiers'
confidence, smoothed; contexts that enough different seeds support give their
kind to the identifiers met in them, whose confidence is the noisy-or of their
contexts'.  Identifiers above the threshold are added wherever they occur; base
spans stay.

Nothing is collected: joins are on context or identifier hashes, pre-aggregated
to distinct edges, and hot keys are split.
"""

from __future__ import annotations

import hashlib
import re
from array import array
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from functools import partial
from itertools import accumulate

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sequora.llm import kernel as K
from sequora.llm.runtime import Tables, attach, lean, numbered, picked, place, ship

KINDS = ("email", "ip", "card", "phone")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# a run of digits either starts a match or has none that starts within it, so runs are tried once
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
#: Tokens end at white space and at signs that stand around a value.
_TOKEN = re.compile(r"[^\s\"'<>=|,;]+")
_GROUPS = re.compile(r"\+?\(?[0-9][0-9().+/\x20-]*+")
_NUMBER = re.compile(r"[0-9]++")
_AT = re.compile(r"[^\s@]@[^\s@]|\S[\[(]at[\])]\S", re.I)
_LETTER = re.compile(r"[^\W\d_]")
_SIGN = re.compile(r"[0-9@]|[\[(]at[\])]", re.I)
_LEADING, _TRAILING = "([{*#%&$", ".!?:)]}*#%&$"
_DIGIT = np.zeros(256, bool)
_DIGIT[[*range(ord("0"), ord("9") + 1), *b"@[("]] = True  # a text without these has nothing


def emails(t: str) -> list[tuple[int, int]]:
    """Leftmost non-overlapping addresses; each @ is tried once with the whole run before it."""
    out, done, a = [], 0, t.find("@")
    while a >= 0:
        s = a
        while s > done and t[s - 1] in _LOCAL:
            s -= 1
        m = _DOMAIN.match(t, a + 1) if s < a else None
        done = m.end() if m else a + 1
        if m:
            out.append((s, done))
        a = t.find("@", done)
    return out


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i % 2:
            d = d * 2 - 9 * (d > 4)
        total += d
    return total % 10 == 0


def base_spans(t: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) by kind, then start; code points, end exclusive."""
    out = [(0, s, e) for s, e in emails(t)]
    out += [(1, m.start(), m.end()) for m in _IP.finditer(t) if all(len(p) <= 3 and int(p) <= 255 for p in (x.lstrip("0") or "0" for x in m[0].split(".")))]
    for m in _CARD.finditer(t):
        d = m[0].replace(" ", "").replace("-", "")
        if 16 <= len(d) <= 19 and luhn(d):
            out.append((2, m.start(), m.end()))
    out += [(3, m.start(), m.end()) for m in _PHONE.finditer(t) if 8 <= sum(c.isdigit() for c in m[0]) <= 15]
    return out


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for k, s, e in spans)


_LETTERS, _ALL_DIGITS = re.compile(r"[^\W\d_]+"), re.compile(r"[0-9]+")


def shape(token: str) -> str:
    """Letters and digits as runs: aB12-x becomes a0-a."""
    return _LETTERS.sub("a", _ALL_DIGITS.sub("0", token))


def exact_shape(token: str) -> str:
    """As shape, with the length of each run of digits."""
    return _LETTERS.sub("a", _ALL_DIGITS.sub(lambda m: f"<{len(m[0])}>", token))


def coarse(token: str) -> str:
    """An address, a number of so many digits, or else the exact shape."""
    return "@" if _AT.search(token) else exact_shape(token) if _LETTER.search(token) else str(sum(map(len, _NUMBER.findall(token))))


def _hash(*parts: str) -> int:
    return int.from_bytes(xxhash.xxh64("\x1f".join(parts).encode("utf-8", "surrogatepass")).digest(), "big", signed=True)


def _stretches(t: str, s: int, e: int, least: int, most: int) -> Iterator[tuple[int, int]]:
    """Of a run of groups of digits, parted at plus signs: each part if it has least to most digits; of one with more, the
    stretches of whole groups from its start or to its end that have so many."""
    while s < e:
        end = t.find("+", s + 1, e)
        end = end if end >= 0 else e
        groups = [m.span() for m in _NUMBER.finditer(t, s, end)]
        digits = sum(b - a for a, b in groups)
        if least <= digits <= most:
            yield s, groups[-1][1]
        elif digits > most:
            n = 0
            for a, b in groups[:most]:  # each has a digit
                n += b - a
                if least <= n <= most:
                    yield s, b
            n = 0
            for a, b in groups[: -most - 1 : -1]:
                n += b - a
                if least <= n <= most:
                    yield a, groups[-1][1]
        s = end


def candidates(t: str, base: list[tuple[int, int, int]], tokens: list[tuple[int, int]], least: int, number: tuple[int, int]) -> list[tuple[int, int]]:
    """Stretches that may be personal data and don't overlap a base span."""
    taken = sorted((s, e) for _, s, e in base)
    starts = [s for s, _ in taken]
    furthest = list(accumulate((e for _, e in taken), max))
    found: dict[tuple[int, int], None] = {}

    def add(s: int, e: int) -> None:
        i = bisect_left(starts, e)
        if s < e and not (i and furthest[i - 1] > s):
            found[s, e] = None

    for s, e in tokens:
        token = t[s:e]
        if not _SIGN.search(token):
            continue
        e -= len(token) - len(token.rstrip(_TRAILING))
        s += len(token) - len(token.lstrip(_LEADING))
        if sum(map(len, _NUMBER.findall(t, s, max(s, e)))) >= least or _AT.search(token):
            add(s, e)
    for m in _GROUPS.finditer(t):
        for s, e in _stretches(t, m.start(), m.end(), *number):
            add(s, e)
    return list(found)


def occurrences(t: str, base: list[tuple[int, int, int]], least: int, number: tuple[int, int]) -> list[tuple[int, ...]]:
    """(kind or -1, start, end, identifier, five contexts) of seeds and candidates."""
    tokens = [m.span() for m in _TOKEN.finditer(t)]
    starts, ends = [s for s, _ in tokens], [e for _, e in tokens]
    names: dict[int, str] = {}

    def name(i: int) -> str:
        if not 0 <= i < len(tokens):
            return ""
        if i not in names:
            token = t[slice(*tokens[i])].lower()
            names[i] = shape(token) if _NUMBER.search(token) else token
        return names[i]

    # the last bit of a context tells those of shape alone from lexical ones
    lexical = lambda *x: _hash(*x) & ~1
    out = []
    for k, s, e in [*base, *((-1, s, e) for s, e in candidates(t, base, tokens, least, number))]:
        token = t[s:e]
        form, rough = shape(token), coarse(token)
        before, after = name(bisect_right(ends, s) - 1), name(bisect_left(starts, e))
        out.append((k, s, e, _hash(token), lexical("b", before, form), lexical("a", form, after), _hash("w", exact_shape(token)) | 1, lexical("c", before, rough), lexical("d", rough, after)))
    return out


_FIELDS = ("kind", "start", "end", "id", "before", "after", "within", "near", "next")
_TYPES = [pa.int32()] * 3 + [pa.int64()] * 6


@lean
def _scan(batches: Iterator[pa.RecordBatch], least: int, number: tuple[int, int]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, offsets = K.string_buffers(batch.column("text"))
        has = np.zeros(batch.num_rows, bool)
        for lo, hi in K.parts(data, offsets):
            at = np.flatnonzero(_DIGIT[data[lo:hi]]) + lo
            has[np.unique(np.searchsorted(offsets, at, "right") - 1)] = True
        counts, sha = np.zeros((batch.num_rows, 4), np.int64), []
        ends, fields = np.zeros(batch.num_rows + 1, np.int32), [array("q") for _ in _FIELDS]
        for i in range(batch.num_rows):
            t = batch.column("text")[i].as_py() if has[i] else ""
            base = base_spans(t) if t else []
            for k, _, _ in base:
                counts[i, k] += 1
            sha.append(hashlib.sha256(joined(base).encode()).hexdigest())
            for o in occurrences(t, base, least, number) if t else ():
                for column, x in zip(fields, o, strict=True):
                    column.append(x)
            ends[i + 1] = len(fields[0])
        occ = pa.StructArray.from_arrays([pa.array(np.frombuffer(f, np.int64) if len(f) else np.zeros(0, np.int64)).cast(kind) for f, kind in zip(fields, _TYPES, strict=True)], _FIELDS)
        occ = pa.ListArray.from_arrays(pa.array(ends), occ)
        yield pa.RecordBatch.from_arrays([batch.column("key"), batch.column("doc_id"), *(pa.array(counts[:, k].copy()) for k in range(4)), pa.array(sha, pa.string()), occ], ["key", "doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "occ"])


def _keyed(docs: DataFrame) -> DataFrame:
    base = picked(docs, doc_id="long", text="string")
    return base.select(F.xxhash64("doc_id", "text").alias("key"), "doc_id", "text")


def extract(docs: DataFrame, spark: SparkSession, rounds: int = 3, support: int = 3, confident: float = 0.7, by_shape: float = 0.9, least_digits: int = 6, number: tuple[int, int] = (8, 19)) -> DataFrame:
    """Per row of docs (doc_id, text, any others): key, doc_id, n_email, n_ip, n_card, n_phone, base_sha256, found.

    found: all spans as structs (kind number, start, end), base and added, by kind, then start.  Counts and base_sha256
    are of base spans.  Null and empty texts have none; repeated rows have equal results; an empty table gives an empty one.
    `support`: different seeds that a context needs; `confident`: least confidence of a context and of an identifier;
    `by_shape`: least confidence of a context of shape alone, without a word beside it;
    `least_digits`: of a token that is a candidate; `number`: digits of groups that are one.
    """
    ship(spark)
    tables = Tables(spark)
    fields = ", ".join(f"{n} {'int' if t == pa.int32() else 'long'}" for n, t in zip(_FIELDS, _TYPES, strict=True))
    schema = f"key long, doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, occ array<struct<{fields.replace(' int', ': int').replace(' long', ': long')}>>"
    rows = tables.write(_keyed(docs).mapInArrow(partial(_scan, least=least_digits, number=number), schema))
    occ = rows.select("key", F.inline("occ"))
    edges = occ.select(F.explode(F.array(*_FIELDS[4:])).alias("context"), "id", "kind").groupBy("context", "id").agg(F.max("kind").alias("kind"), F.count("*").alias("m"))
    edges = tables.write(edges)
    ids = tables.write(edges.groupBy(F.col("id").alias("id_")).agg(F.max("kind").alias("k"), F.count("*").alias("n"), (F.sum("m") / len(_FIELDS[4:])).cast("long").alias("met")))
    contexts = tables.write(edges.groupBy(F.col("context").alias("c_")).agg(F.count("*").alias("n"), F.count_if(F.col("kind") >= 0).alias("s")))
    total = lambda df, n: df.agg(F.coalesce(F.max(n), F.lit(0)).alias("most"), F.coalesce(F.sum(n), F.lit(0)).alias("total")).first()
    of_id, of_context, of_met = total(ids, "n"), total(contexts, "n"), total(ids, "met")
    contexts = contexts.where(F.col("s") >= support).select("c_", "n")
    seeds = ids.where("k >= 0").select("id_", "k", F.lit(1.0).alias("score"), "n", "met")
    known = seeds
    for _ in range(rounds):
        by_kind = attach(edges, "id", known.drop("met"), "id_", "n", of_id.most, of_id.total).groupBy("context", "k")
        by_kind = by_kind.agg(F.sum("score").alias("w"), F.count_if(F.col("kind") >= 0).alias("s"))
        top = by_kind.groupBy("context").agg(F.max(F.struct("w", "k", "s")).alias("top")).join(contexts, F.col("context") == F.col("c_"))
        top = top.select("c_", "top.k", (F.col("top.w") / (F.col("n") + 1)).alias("c"), "n").where((F.col("top.s") >= support) & (F.col("c") >= F.when(F.col("c_").bitwiseAND(F.lit(1)) == 1, by_shape).otherwise(confident)))
        reached = attach(edges.where("kind < 0").select("context", "id"), "context", top, "c_", "n", of_context.most, of_context.total)
        reached = reached.groupBy("id").agg(F.max(F.struct("c", "k"))["k"].alias("k"), (1 - F.exp(F.sum(F.log(1 - F.least("c", F.lit(0.99)))))).alias("score")).where(F.col("score") >= confident)
        reached = reached.join(ids.where("k < 0").select("id_", "n", "met"), F.col("id") == F.col("id_")).select("id_", "k", "score", "n", "met")
        known = tables.write(seeds.unionByName(reached))
    added = attach(occ.where("kind < 0").select("key", "start", "end", "id"), "id", known.drop("n", "score"), "id_", "met", of_met.most, of_met.total).select("key", F.col("k").alias("kind"), "start", "end")
    added = added.groupBy("key").agg(F.collect_set(F.struct("kind", "start", "end")).alias("added")).withColumnRenamed("key", "key_")
    own = F.transform(F.filter("occ", lambda o: o["kind"] >= 0), lambda o: F.struct(o["kind"].alias("kind"), o["start"].alias("start"), o["end"].alias("end")))
    none = F.array().cast("array<struct<kind int, start int, end int>>")
    out = rows.join(added, F.col("key") == F.col("key_"), "left")
    return out.select("key", "doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", F.array_sort(F.array_union(own, F.coalesce("added", none))).alias("found"))


def digest(docs: DataFrame, spark: SparkSession, **options: object) -> DataFrame:
    """extract() with the spans as text, kind:start:end joined by commas."""
    names = F.array(*(F.lit(k) for k in KINDS))
    one = lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))
    got = extract(docs, spark, **options)
    return got.select("doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", F.array_join(F.transform("found", one), ",").alias("spans"))


@lean
def _mask(batches: Iterator[pa.RecordBatch], text: str) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = []
        for t, spans in zip(batch.column(text).to_pylist(), batch.column("found").to_pylist(), strict=True):
            parts, done = [], 0
            for s, e, k in sorted((x["start"], -x["end"], x["kind"]) for x in spans):
                if s >= done:
                    parts += [t[done:s], f"[{KINDS[k].upper()}]"]
                done = max(done, -e)
            texts.append("".join(parts) + t[done:])
        at = batch.schema.get_field_index(text)
        yield batch.set_column(at, text, pa.array(texts, batch.column(text).type)).drop_columns(["found"])


def redact(docs: DataFrame, spark: SparkSession, **options: object) -> DataFrame:
    """docs with every span of text replaced by its kind in brackets; columns stay (n_chars, if there, follows the text)."""
    found = extract(docs, spark, **options).where(F.size("found") > 0).select(F.col("key").alias("key_"), "found").dropDuplicates(["key_"])
    plain, text = numbered(docs), place(docs, "text")
    rows = plain.join(found, F.xxhash64(F.col(place(docs, "doc_id")).cast("long"), F.col(text).cast("string")) == F.col("key_"), "left").drop("key_")
    clean, hit = rows.where(F.col("found").isNull()).drop("found"), rows.where(F.col("found").isNotNull())
    masked = hit.mapInArrow(partial(_mask, text=text), plain.schema)
    if "n_chars" in docs.columns:
        masked = masked.withColumn(place(docs, "n_chars"), F.length(text).cast(plain.schema[place(docs, "n_chars")].dataType))
    return clean.unionByName(masked).toDF(*docs.columns)
