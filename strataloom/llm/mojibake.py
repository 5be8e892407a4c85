"""Text that was decoded with the wrong character encoding: found and restored.

Method: expectation-maximization with latent encoding chains. A chain is a sequence of steps, each
"was read as W, is R". Undoing a chain turns an observed text into a candidate original, whose
log-likelihood under a character model is the evidence of that record. The weight of each
chain is estimated per source and field, shrunk to its weight over all records, so that weak
evidence of single records is pooled; the posterior of each record decides on its repair.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strataloom.session import cut, spread

#: Encodings that texts are wrongly read as, and encodings that they are in.
READ_AS = ["cp1252", "mac_roman", "cp850", "cp437", "cp1251", "cp1250", "iso8859_2", "koi8_r", "cp866", "cp1253", "cp1254"]
READ_AS_WIDE = ["gb18030", "cp932", "cp950", "euc_kr"]
WIDE = ["cp950", "cp932", "gb18030", "euc_jp"]
NARROW = ["cp1252", "cp1251", "koi8_r", "cp866", "cp1250", "iso8859_2", "mac_roman", "cp850"]
#: (read as, is): every pair tried as one step
STEPS = (
    [(w, "utf_8") for w in READ_AS + READ_AS_WIDE]
    + [(w, r) for w in ("cp1252", "mac_roman", "cp850", "cp1251") for r in WIDE]
    + [(w, r) for w in ("cp1252", "mac_roman", "cp850", "cp1251", "koi8_r") for r in NARROW if r != w]
)
MAX_STEPS = 3
#: Price of a step in log-likelihood: UTF-8 checks itself, others fit too easily.
UTF8_PRICE, OTHER_PRICE = 2.0, 9.0
LATER_GAIN = 30.0  # what a step other than UTF-8 must gain after another step
LOST = "�"

VALID = re.compile(rb"(?:[\xc2-\xdf][\x80-\xbf]|\xe0[\xa0-\xbf][\x80-\xbf]|\xed[\x80-\x9f][\x80-\xbf]|[\xe1-\xec\xee\xef][\x80-\xbf]{2}|\xf0[\x90-\xbf][\x80-\xbf]{2}|[\xf1-\xf3][\x80-\xbf]{3}|\xf4[\x80-\x8f][\x80-\xbf]{2})+")


@lru_cache(None)
def _table(codec: str) -> tuple[dict[str, int], list[str], re.Pattern, re.Pattern]:
    """Of a one-byte encoding: byte of a character, character of a byte, runs of high and of any of its characters.
    Bytes it leaves undefined are the control characters of the same number, and cp1252 takes these for all."""
    chars = []
    for b in range(256):
        try:
            chars.append(bytes([b]).decode(codec))
        except UnicodeDecodeError:
            chars.append(chr(b))
    of = {c: b for b, c in enumerate(chars)}
    if codec == "cp1252":
        of.update({chr(b): b for b in range(128, 160) if chr(b) not in of})
    high = "".join(re.escape(c) for c, b in of.items() if b > 127)
    return of, chars, re.compile(f"[{high}]+"), re.compile(f"[\\x00-\\x09\\x0b-\\x0c\\x0e-\\x7f{high}]+")


def _bytes(run: str, codec: str) -> bytes:
    of = _table(codec)[0]
    return bytes([of[c] for c in run])


def _pair_rows(texts: Iterable[str]) -> pd.DataFrame:
    """(a, b, plain, capitals): how often code point b follows a, a line end before a text's first, as written and in capitals."""
    plain: Counter = Counter()
    capitals: Counter = Counter()
    for t in texts:
        for counts, v in ((plain, t), (capitals, t.upper())):
            counts.update(zip("\n" + v, v))
    pairs = list(dict.fromkeys([*plain, *capitals]))
    rows = [(ord(a), ord(b), plain[a, b], capitals[a, b]) for a, b in pairs]
    return pd.DataFrame(rows, columns=["a", "b", "plain", "capitals"])


def pair_counts(samples: DataFrame, text: str) -> pd.DataFrame:
    """(a, b, plain, capitals) of all samples, added up before they move: at most as many rows as there are different pairs of characters."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield _pair_rows(pdf["t"])

    part = samples.where(F.col(text).isNotNull()).select(F.col(text).alias("t")).mapInPandas(count, "a int, b int, plain bigint, capitals bigint")
    return part.groupBy("a", "b").agg(F.sum("plain").alias("plain"), F.sum("capitals").alias("capitals")).toPandas()


class CharModel:
    """Log-probabilities of characters given the one before, in a hashed table; unseen ones by their kind."""

    BITS = 18

    def __init__(self, texts: list[str], corpus: dict[int, int] | None = None, pairs: pd.DataFrame | None = None):
        """Of clean ``texts``, or of what ``pair_counts`` counted in them."""
        if pairs is None:
            pairs = _pair_rows(texts)
        first, then = pairs["a"].to_numpy(np.int64), pairs["b"].to_numpy(np.int64)
        weight = pairs["plain"].to_numpy(float) + 0.1 * pairs["capitals"].to_numpy(float)
        one = np.bincount(then, weight, 0x110000)
        total = one.sum() or 1.0
        kind = np.full(0x110000, -10.5, np.float32)  # by kind: symbols
        for lo, hi, lp in (
            (0x20, 0x7F, -7.0), (0x09, 0x0E, -7.0), (0x00, 0x09, -20.0), (0x0E, 0x20, -20.0), (0x7F, 0xA0, -22.0), (0xA0, 0xA1, -12.0), (0xAD, 0xAE, -18.0),
            (0xC0, 0x180, -12.5), (0x400, 0x460, -11.5), (0x3000, 0x3100, -10.5), (0x3400, 0x4E00, -20.0), (0x4E00, 0xA000, -11.5), (0xAC00, 0xD7A4, -15.0), (0xFF00, 0xFF60, -11.0),
            (0xFF60, 0xFFA0, -17.0), (0x2010, 0x2027, -10.0), (0x1F300, 0x1FB00, -12.0), (0xE000, 0xF900, -24.0), (0xFFFD, 0xFFFE, -14.0), (0x2500, 0x25A0, -18.0),
        ):
            kind[lo:hi] = lp
        self.one = kind
        known = np.flatnonzero(one)
        self.one[known] = np.log(one[known] / total * 0.98 + 1e-7)
        seen = sum((corpus or {}).values()) or 1
        for c, n in (corpus or {}).items():
            self.one[c] = max(self.one[c], np.log(0.3 * n / seen))
        self.both = np.full(1 << self.BITS, -np.inf, np.float32)
        if len(first):
            np.maximum.at(self.both, self._at(first, then), np.log(0.75 * weight / np.maximum(one[first], weight) + 1e-9).astype(np.float32))
        self.rest = np.float32(np.log(0.25))
        self.kept: dict[str, float] = {}
        self.runs: dict[tuple[str, str], dict[str, str]] = {}

    def _at(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        h = a.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + b.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)
        return ((h ^ (h >> np.uint64(31))) * np.uint64(0x94D049BB133111EB) >> np.uint64(64 - self.BITS)).astype(np.int64)

    def logs(self, c: np.ndarray) -> np.ndarray:
        before = np.empty_like(c)
        before[:1], before[1:] = 10, c[:-1]
        return np.logaddexp(self.both[self._at(before, c)], self.one[c] + self.rest)

    def score(self, text: str) -> float:
        """Log-likelihood of a text; those of the last short ones are kept."""
        if not text:
            return 0.0
        if len(text) > 40:
            return self._score(text)
        if text not in self.kept:
            if len(self.kept) > 50_000:
                self.kept.clear()
            self.kept[text] = self._score(text)
        return self.kept[text]

    def _score(self, text: str) -> float:
        return float(self.logs(np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)).sum())


def _decoded_run(run: str, w: str) -> str:
    raw = _bytes(run, w)
    out, at = [], 0
    for v in VALID.finditer(raw):
        out.append(run[at : v.start()])
        out.append(v.group(0).decode("utf-8"))
        at = v.end()
    return "".join(out) + run[at:]


_short_run = lru_cache(100_000)(_decoded_run)


def _utf8(text: str, w: str) -> str:
    """Every valid UTF-8 sequence among the high characters of W decoded; all else stays."""
    return _table(w)[2].sub(lambda m: _short_run(m.group(0), w) if m.end() - m.start() < 32 else _decoded_run(m.group(0), w), text)


WIDE_RUN = re.compile(r"[^\x00-\x7f]+")


def _wide_utf8(text: str, w: str) -> str:
    """Runs of characters that are UTF-8 once encoded in a wide W."""

    def run(m: re.Match) -> str:
        s = m.group(0)
        for end in (len(s), len(s) - 1):  # a broken last character took the next one along
            try:
                return s[:end].encode(w).decode("utf-8") + s[end:] if end else s
            except UnicodeError:
                continue
        return s

    return WIDE_RUN.sub(run, text)


SENTENCE = re.compile(r"(?<=[.!?])(?= )")


def _other(text: str, w: str, r: str, model: CharModel) -> str:
    """Runs of W's characters decoded as R where that is valid and likelier; a run that isn't is tried by sentence."""
    any_run = _table(w)[3]
    known = model.runs.setdefault((w, r), {})  # what the last short runs became under this step
    if len(known) > 20_000:
        known.clear()

    def better(s: str) -> str | None:
        try:
            d = _bytes(s, w).decode(r)
        except UnicodeDecodeError:
            return None
        return d if d != s and model.score(d) > model.score(s) else None

    def mended(s: str) -> str:
        d = better(s)
        return d if d is not None else "".join(p if p.isascii() else better(p) or p for p in SENTENCE.split(s))

    def run(m: re.Match) -> str:
        s = m.group(0)
        if s.isascii():
            return s
        if len(s) > 400:
            return mended(s)
        if s not in known:
            known[s] = mended(s)
        return known[s]

    return any_run.sub(run, text)


def undo(text: str, step: tuple[str, str], model: CharModel) -> str:
    """The text with one step undone, wherever that is possible."""
    w, r = step
    if r == "utf_8":
        return _wide_utf8(text, w) if w in READ_AS_WIDE else _utf8(text, w)
    return _other(text, w, r, model)


def chain_name(steps: tuple[tuple[str, str], ...]) -> str:
    return " ".join(f"{w}>{r}" for w, r in steps) or "none"


def undo_chain(text: str, name: str, model: CharModel) -> str:
    if name != "none":
        for part in name.split(" "):
            w, r = part.split(">")
            text = undo(text, (w, r), model)
    return text


ODD = -9.0  # log-probability under which a character that a one-byte encoding has is suspicious
RARE, RARE_SHARE = -12.5, 0.3  # the same of characters of wide scripts, by themselves, and the share of a line's they must have


PIECE = re.compile(r"\n|(?<=[.!?]) ")
#: the branches a drawn tree has before a name in plain characters
TREE = re.compile(r"(?m)^[ \t\xa0]*(?:[│├└][─ \t\xa0]*)+(?=[ -~]|$)")


@lru_cache(None)
def _kinds() -> tuple[np.ndarray, np.ndarray]:
    """Of each code point: whether a one-byte encoding that texts are wrongly read as has it; whether only a wide one has."""
    narrow = np.zeros(0x110000, bool)
    for codec in READ_AS:
        of = _table(codec)[0]
        narrow[[ord(c) for c, b in of.items() if b > 127]] = True
    wide = np.zeros(0x110000, bool)
    wide[0x3040:0xA000] = wide[0xAC00:0xD7A4] = wide[0xFF60:0xFFA0] = wide[0xE000:0xF900] = True
    return narrow, wide


def odd_characters(c: np.ndarray, model: CharModel) -> np.ndarray:
    """Whether each code point is suspicious: unlikely, and a character that wrong decoding makes."""
    narrow, wide = _kinds()
    return (narrow[c] & (model.logs(c) < ODD) & (c > 127)) | (wide[c] & (model.one[c] < RARE))


def _points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def suspicious(text: str, model: CharModel) -> tuple[str, str]:
    """The distinct sentences with suspicious characters, a line each, and these characters.

    A stop and a blank are no second bytes in any encoding, so no garbled character is cut.
    """
    lines = [x for x in dict.fromkeys(PIECE.split(text)) if not x.isascii()]
    if not lines:
        return "", ""
    joined = "\n".join(lines)
    c = _points(joined)
    odd = odd_characters(c, model)
    for m in TREE.finditer(joined):
        odd[m.start() : m.end()] = False
    if not odd.any():
        return "", ""
    line = np.cumsum(c == 10)
    narrow = np.bincount(line[odd & _kinds()[0][c]], minlength=len(lines))
    share = np.bincount(line[odd], minlength=len(lines)) / np.maximum(1, np.bincount(line[c > 127], minlength=len(lines)))
    keep = np.flatnonzero((narrow > 0) | (share >= RARE_SHARE))
    kept = odd & np.isin(line, keep)
    return "\n".join(lines[k] for k in keep), "".join(map(chr, np.unique(c[kept])))


def _may(step: tuple[str, str], odd: str) -> bool:
    """Whether a step can have made any of the suspicious characters; those to UTF-8 check themselves."""
    w, r = step
    return r == "utf_8" or any(c in _table(w)[0] for c in odd)


def chains(text: str, model: CharModel, keep: int = 6) -> list[tuple[str, float]]:
    """(chain, gain): chains that change the text, by the gain of the log-likelihood, less the price of its steps; the best come first.

    All sentences with suspicious characters count, each distinct one once. UTF-8 checks itself, so where a step
    to it leaves nothing suspicious, no others are tried, and only steps to it are followed by further ones.
    """
    text, odd = suspicious(text, model)
    if not text:
        return []
    base = model.score(text)
    found: dict[str, float] = {}
    seen = {text}
    front: list[tuple[tuple, str, float, float, str]] = [((), text, base, 0.0, odd)]
    for _ in range(MAX_STEPS):
        grown = []
        settled = False
        for steps, t, own, paid, left in front:
            for step in STEPS:
                if settled and step[1] != "utf_8":
                    break  # the steps to UTF-8 come first
                if not _may(step, left):
                    continue
                u = undo(t, step, model)
                if u in seen:
                    continue
                seen.add(u)
                s = model.score(u)
                if steps and step[1] != "utf_8" and s < own + LATER_GAIN:
                    continue
                price = UTF8_PRICE if step[1] == "utf_8" else OTHER_PRICE
                found[chain_name((*steps, step))] = s - base - paid - price
                if s > own + price:
                    rest = suspicious(u, model)[1]
                    settled |= step[1] == "utf_8" and not rest
                    if rest and step[1] == "utf_8":
                        grown.append(((*steps, step), u, s, paid + price, rest))
        front = sorted(grown, key=lambda x: -x[2])[:3]
        if settled or not front:
            break
    ranked = sorted(found.items(), key=lambda x: (-x[1], len(x[0]), x[0]))
    return [(n, g) for n, g in ranked if g > 0][:keep]


def letter_counts(df: DataFrame, text: str) -> dict[int, int]:
    """How often each letter beyond Latin and Greek occurs in all texts: at most as many rows as Unicode has letters.

    Wrong decoding rarely makes common letters of these scripts, so all records count, garbled ones too.
    """
    want = re.compile("[\u0400-\u052f\u0590-\u06ff\u0900-\u0e7f\u3040-\u30ff\u3400-\u9fff\uac00-\ud7a3]")

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: Counter = Counter()
        for pdf in batches:
            for t in pdf["t"]:
                sums.update(want.findall(t))
        yield pd.DataFrame({"c": [ord(c) for c in sums], "n": list(sums.values())}, columns=["c", "n"])

    part = df.where(F.col(text).rlike(r"[^\x00-\x{3ff}]")).select(F.col(text).alias("t")).mapInPandas(count, "c int, n bigint")
    return {r["c"]: r["n"] for r in part.groupBy("c").agg(F.sum("n").alias("n")).collect()}


LOST_IN_WORD, LOST_ALONE = 45.0, 4.0  # gains of a replacement character beside a letter, which no sound text has, and of one that stands alone


def lost_characters(odd: DataFrame) -> DataFrame:
    """Evidence of a chain ``lost``: characters that wrong decoding replaced, so that the text can't be restored.

    A text may speak of the replacement character; one that stands alone says little by itself and counts with the other records of its source.
    """
    count = lambda p: F.size(F.regexp_extract_all("t", F.lit(p), F.lit(0)))
    within = count(r"(?<=\p{L})\x{FFFD}|\x{FFFD}(?=\p{L})")
    gain = within * LOST_IN_WORD + (count(r"\x{FFFD}") - within) * LOST_ALONE
    return odd.where(F.col("t").contains(LOST)).select("key", "source", "field", F.lit("lost").alias("chain"), gain.alias("gain"))


PSEUDO = 5.0  # records' worth of the overall weights that every source starts from
CLEAN = 0.97  # share of clean records that the first round starts from
STRONG = 40.0  # gain at which a record alone, or the records of a source and field together, speak for a chain
FLOOR = 1e-9  # weight of a chain that nothing speaks for


def posterior(evidence: DataFrame, sizes: DataFrame, rounds: int = 4) -> DataFrame:
    """(key, chain, p): each record's likeliest chain by expectation-maximization.

    ``evidence(key, source, field, chain, gain)`` has the chains of records that any chain changes;
    ``sizes(source, field, n)`` counts all records. A round joins weights to the evidence,
    normalises it per record and sums it per source, field and chain, combined before the shuffle.
    """
    group = ["source", "field"]
    evidence = cut(evidence)
    per_key = evidence.groupBy("key", *group).agg(F.lit("none").alias("chain"), F.lit(0.0).alias("gain"))
    evidence = cut(evidence.unionByName(per_key))
    kinds = evidence.where("chain != 'none'").select("chain").distinct().count()
    own = evidence.select(*group, "chain").distinct().withColumn(
        "w", F.when(F.col("chain") == "none", CLEAN).otherwise(F.lit((1 - CLEAN) / max(1, kinds)))
    )
    total = sizes.agg(F.sum("n")).first()[0] or 1
    for k in range(rounds + 1):
        own = cut(own)
        # the E step: few rows a record; a hot source is split by the key
        scored = evidence.join(own, [*group, "chain"]).withColumn("s", F.col("gain") + F.log("w"))
        top = scored.groupBy("key").agg(F.max("s").alias("m"))
        scored = scored.join(top, "key").withColumn("e", F.exp(F.col("s") - F.col("m")))
        norm = scored.groupBy("key").agg(F.sum("e").alias("z"))
        post = cut(scored.join(norm, "key").select("key", *group, "chain", "gain", (F.col("e") / F.col("z")).alias("p")))
        if k == rounds:
            break
        # the M step
        mass = post.where("chain != 'none'").groupBy(*group, "chain").agg(F.sum("p").alias("c"))
        overall = post.where(F.col("gain") >= STRONG).groupBy("chain").agg(F.sum("p").alias("g")).where("g > 0.5")
        # what a source's records gain together over none having the chain, if as many have it as the posterior says
        w = F.least(F.col("c") / F.col("n"), F.lit(0.999))
        rate = mass.join(sizes, group).select(*group, "chain", "n", w.alias("w"))
        each = F.col("gain") + F.log(F.col("w") + (1 - F.col("w")) * F.exp(-F.col("gain")))
        pooled = post.where("chain != 'none'").join(rate, [*group, "chain"]).groupBy(*group, "chain").agg(
            (F.sum(F.col("p") * each) + (F.max("n") - F.sum("p")) * F.log1p(-F.max("w"))).alias("together")
        )
        strong = mass.join(overall.select("chain"), "chain", "left_semi").select(*group, "chain")
        kept = strong.unionByName(pooled.where(F.col("together") >= STRONG).select(*group, "chain")).distinct()
        mass = mass.join(kept, [*group, "chain"], "left_semi").select(*group, "chain", "c")
        found = mass.groupBy(*group).agg(F.sum("c").alias("f"))
        all_found = mass.agg(F.sum("c")).first()[0] or 0.0
        rest = own.select(*group, "chain").join(mass, [*group, "chain"], "left").join(overall, "chain", "left").join(found, group, "left").join(sizes, group)
        g = F.when(F.col("chain") == "none", F.lit(1 - all_found / total)).otherwise(F.coalesce("g", F.lit(0.0)) / total + FLOOR)
        c = F.when(F.col("chain") == "none", F.col("n") - F.coalesce("f", F.lit(0.0))).otherwise(F.coalesce("c", F.lit(0.0)))
        own = rest.select(*group, "chain", F.greatest((c + PSEUDO * g) / (F.col("n") + PSEUDO), F.lit(FLOOR / 100)).alias("w"))
    return post.groupBy("key").agg(F.max_by("chain", F.struct(F.round("p", 9), "chain")).alias("chain"), F.max("p").alias("p"))


def restore(df: DataFrame, key: str, text: str, source: str, field: str, samples: DataFrame, sample_text: str = "text") -> DataFrame:
    """(key, chain, p, restored): every record with garbled text; restored is null where characters were lost.

    The character model is fitted on all clean sentences of ``samples`` and the letters of all records. Null, empty and clean texts give
    no rows; a null source or field is a source of its own. ``key`` must be unique. Only sums per
    source and field, and one chain a record, are shuffled; texts stay where they are read twice.
    """
    kind = df.schema[key].dataType.simpleString()
    base = df.select(
        F.col(f"`{key}`").alias("key"),
        F.col(f"`{text}`").alias("t"),
        F.coalesce(F.col(f"`{source}`").cast("string"), F.lit("")).alias("source"),
        F.coalesce(F.col(f"`{field}`").cast("string"), F.lit("")).alias("field"),
    )
    odd = spread(base.where(F.col("t").rlike(r"[^\x00-\x7f]")))
    shared = df.sparkSession.sparkContext.broadcast(CharModel([], letter_counts(odd, "t"), pair_counts(samples, sample_text)))  # 6 MB, fixed

    def look(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = shared.value
        for pdf in batches:
            rows = [(k, s, f, n, g) for k, t, s, f in zip(pdf["key"], pdf["t"], pdf["source"], pdf["field"]) for n, g in chains(t, model)]
            yield pd.DataFrame(rows, columns=["key", "source", "field", "chain", "gain"])

    evidence = odd.mapInPandas(look, f"key {kind}, source string, field string, chain string, gain double")
    sizes = cut(base.groupBy("source", "field").agg(F.count("*").alias("n")))
    chosen = posterior(evidence.unionByName(lost_characters(odd)), sizes).where("chain != 'none'")
    chosen = cut(chosen)

    def mend(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = shared.value
        for pdf in batches:
            got = [None if c == "lost" else undo_chain(t, c, model) for t, c in zip(pdf["t"], pdf["chain"])]
            pdf = pdf.assign(restored=[None if g is None or LOST in g else g for g in got])
            yield pdf[["key", "chain", "p", "restored"]]

    out = odd.select("key", "t").join(chosen, "key").mapInPandas(mend, f"key {kind}, chain string, p double, restored string")
    return out.withColumnRenamed("key", key)
