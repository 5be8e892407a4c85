"""Languages of documents and of the segments of mixed ones, with a confidence.

Method: hierarchical discrimination. Linear support vector machines, one against the rest, first
predict the language family of a sentence, then machines, one against one, separate the languages
within the family. Features are hashed character n-grams, weighted by their share of the text, so
a sentence's scores are sums over its characters: the scores of all characters of a batch are
looked up at once, and differences of their running sums score every sentence. Sentences
vote along the text: a change of language has a price, so a single foreign term makes no segment.
The machines are fitted on the labelled sample sentences, at most SAMPLE_ROWS of them.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Families of the languages of the data.
FAMILIES = {
    "germanic": ["de", "en", "nl"],
    "romance": ["es", "fr", "pt"],
    "slavic": ["pl"],
    "cyrillic": ["ru"],
    "chinese": ["zh-tw"],
    "japanese": ["ja"],
}
#: Codes and names a label may use.
NAMES = {
    "en": "en eng english",
    "de": "de deu ger german deutsch",
    "fr": "fr fra fre french français francais",
    "es": "es spa spanish español espanol castellano castilian",
    "pt": "pt por portuguese português portugues",
    "nl": "nl nld dut dutch nederlands",
    "pl": "pl pol polish polski",
    "ru": "ru rus russian русский",
    "ja": "ja jpn japanese 日本語 にほんご",
    "zh-tw": "zh zho chi cmn chinese mandarin 中文 繁體中文 繁体中文 正體中文 正体中文 漢語 汉语 國語 国语 華語",
}
SAMPLE_ROWS = 2000
DIM_BITS = 16
ORDERS = (1, 2, 3, 4)
SWITCH = 3.0  # price of a change of language along a text, in evidence
LEAST_LETTERS = 20  # letters a segment must have; of scripts without blanks a third
DOUBT_LETTERS, DOUBT = 45, 0.75  # a segment of fewer letters must be at least so sure
LETTER_EVIDENCE = 40.0  # letters at which a sentence counts fully


def label_language(label: Column) -> Column:
    """The language code a label names, or null: a code of two or three letters, with or without region
    or script, or an English or native name, in any case."""
    names = {n: code for code, ns in NAMES.items() for n in ns.split()}
    table = F.create_map(*[F.lit(x) for kv in names.items() for x in kv])
    clean = F.lower(F.trim(label, F.lit(" \t\r\n")))
    head = F.regexp_extract(clean, r"^([a-z]{2,3})(?:[-_][a-z]{4})?(?:[-_](?:[a-z]{2}|[0-9]{3}))?(?:[.@].*)?$", 1)
    bare = F.regexp_replace(clean, r"\s*[(（].*[)）]\s*$", "")
    return F.coalesce(F.try_element_at(table, head), F.try_element_at(table, bare))


# ---------------------------------------------------------------- features


def _codes(text: str) -> np.ndarray:
    """Code points of a lower-case text."""
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def _letters() -> np.ndarray:
    table = np.zeros(0x110000, bool)
    for lo, hi in ((0x41, 0x5B), (0x61, 0x7B), (0xAA, 0xAB), (0xB5, 0xB6), (0xBA, 0xBB), (0xC0, 0xD7), (0xD8, 0xF7), (0xF8, 0x2B0), (0x300, 0x530), (0x3040, 0x3100), (0x3400, 0xA000), (0xAC00, 0xD7A4), (0xF900, 0xFB00), (0xFF66, 0xFF9E), (0x20000, 0x30000)):
        table[lo:hi] = True
    return table


LETTER = _letters()


def hashes(codes: np.ndarray) -> list[np.ndarray]:
    """Bucket of the n-gram that ends at each position, for each order; runs of other characters are one blank kind."""
    c = np.where(LETTER[codes], codes, np.uint32(32)).astype(np.uint64)
    out = []
    for n in ORDERS:
        h = np.full(len(c), 1469598103934665603 + n, np.uint64)
        for k in range(n - 1, -1, -1):
            shifted = np.r_[np.full(min(k, len(c)), 32, np.uint64), c[: max(0, len(c) - k)]]
            h = (h ^ shifted) * np.uint64(1099511628211)
            h ^= h >> np.uint64(29)
        out.append((h >> np.uint64(64 - DIM_BITS)).astype(np.int64))
    return out


def _features(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of a text's n-grams and their shares."""
    codes = _codes(text.lower())
    live = LETTER[codes]
    at, n = np.unique(np.concatenate([h[live] for h in hashes(codes)]), return_counts=True)
    return at, n / max(1, int(live.sum()))


def _svm(gram: np.ndarray, y: np.ndarray, rounds: int = 40, c: float = 200.0) -> np.ndarray:
    """Signed multipliers of a linear support vector machine, squared hinge loss, by dual coordinate descent."""
    soft = 1.0 / (2 * c)
    norms = gram.diagonal() + soft
    alpha, margin = np.zeros(len(y)), np.zeros(len(y))
    rng = np.random.default_rng(5)
    for _ in range(rounds):
        for i in rng.permutation(len(y)).tolist():
            new = max(alpha[i] - (y[i] * margin[i] - 1 + alpha[i] * soft) / norms[i], 0.0)
            if new != alpha[i]:
                margin += ((new - alpha[i]) * y[i]) * gram[i]
                alpha[i] = new
    return alpha * y


class Model:
    """Weights, one column a machine: families first, then the pairs within each family."""

    def __init__(self, texts: list[str], langs: list[str]):
        known = {code: f for f, codes in FAMILIES.items() for code in codes}
        pairs = [(t, l) for t, l in zip(texts, langs) if t and l in known]
        # sentences and their halves, so that short ones are known as well
        sample = [(t[a:b], l) for t, l in pairs for a, b in ((0, None), (0, len(t) // 2), (len(t) // 2, None))]
        found = [_features(t) for t, _ in sample]
        used = np.unique(np.concatenate([at for at, _ in found]))
        x = np.zeros((len(sample), len(used)), np.float32)
        for row, (at, share) in zip(x, found):
            row[np.searchsorted(used, at)] = share
        lang = np.array([l for _, l in sample])
        family = np.array([known[l] for l in lang])
        self.families = [f for f in FAMILIES if f in set(family)]
        self.langs = [l for f in self.families for l in FAMILIES[f] if l in set(lang)]
        self.pairs: list[tuple[str, str]] = []
        gram = (x @ x.T).astype(np.float64)
        columns = [_svm(gram, np.where(family == f, 1.0, -1.0)) @ x for f in self.families]
        for f in self.families:
            own = [l for l in FAMILIES[f] if l in self.langs]
            for i, a in enumerate(own):
                for b in own[i + 1 :]:
                    rows = np.flatnonzero((lang == a) | (lang == b))
                    columns.append(_svm(gram[np.ix_(rows, rows)], np.where(lang[rows] == a, 1.0, -1.0)) @ x[rows])
                    self.pairs.append((a, b))
        self.weights = np.zeros((1 << DIM_BITS, len(columns)), np.float32)
        self.weights[used] = np.stack(columns, 1)

    def scores(self, sums: np.ndarray) -> np.ndarray:
        """Log-probability-like score of each language from the machines' mean margins, a row a sentence."""
        nf = len(self.families)
        fam = sums[:, :nf] * 4
        fam = fam - np.logaddexp.reduce(fam, axis=1, keepdims=True)
        out = np.empty((len(sums), len(self.langs)), np.float32)
        for k, l in enumerate(self.langs):
            f = next(i for i, f in enumerate(self.families) if l in FAMILIES[f])
            rivals = [(j, 1 if a == l else -1) for j, (a, b) in enumerate(self.pairs) if l in (a, b)]
            inner = sum((-np.logaddexp(0, -4 * s * sums[:, nf + j]) for j, s in rivals), np.zeros(len(sums)))
            out[:, k] = fam[:, f] + inner
        return out


# ---------------------------------------------------------------- sentences

FENCED = re.compile(r"^[ \t]{0,3}(```+|~~~+)[^\n]*\n.*?(?:^[ \t]{0,3}\1[ \t]*\r?$|\Z)", re.S | re.M)
#: what carries no language: code, addresses, encoded data, tags
NEUTRAL = re.compile(r"(?:^(?:    |\t)[^\n]*$)|`[^`\n]+`|https?://\S+|data:\S+|[A-Za-z0-9+/=_]{40,}|<[^<>\n]{1,200}>|(?<!\S)#[^\s#]+|\S+@\S+\.\S+", re.M)
BREAK = re.compile(r"(?<=[.!?…])[\"”’»)\]]*(?=\s)|(?<=[。！？])[」』）]*|\r?\n")


def _blank(m: re.Match) -> str:
    return re.sub(r"[^\n]", " ", m.group(0))


def masked(text: str) -> str:
    """The text with what carries no language blanked out; positions stay."""
    if "```" in text or "~~~" in text:
        text = FENCED.sub(_blank, text)
    return NEUTRAL.sub(_blank, text)


def _breaks(text: str) -> np.ndarray:
    ends = [m.end() for m in BREAK.finditer(text)]
    if not ends or ends[-1] < len(text):
        ends.append(len(text))
    return np.array(ends, np.int64)


def _path(score: np.ndarray, weight: np.ndarray, switch: float) -> np.ndarray:
    """The best language of each sentence along one text, changes priced."""
    gain = score * weight[:, None]
    total = gain[0].copy()
    back = np.zeros(score.shape, np.int16)
    for i in range(1, len(gain)):
        best = int(total.argmax())
        stay = total >= total[best] - switch
        back[i] = np.where(stay, np.arange(len(total)), best)
        total = np.where(stay, total, total[best] - switch) + gain[i]
    out = np.empty(len(gain), np.int64)
    out[-1] = int(total.argmax())
    for i in range(len(gain) - 1, 0, -1):
        out[i - 1] = back[i, out[i]]
    return out


def _sure(score: np.ndarray, weight: np.ndarray, run: tuple[np.ndarray, int]) -> float:
    """Confidence of a run of sentences in its language."""
    own, lang = run
    mean = (score[own] * weight[own][:, None]).sum(0) / max(1e-6, float(weight[own].sum()))
    return float(np.exp(mean[lang] - np.logaddexp.reduce(mean)))


def _solid(letters: int, lang: str, sure: float) -> bool:
    """Whether a run may be a segment among others."""
    share = 3 if lang in ("zh-tw", "ja") else 1
    return letters * share >= LEAST_LETTERS and (letters * share >= DOUBT_LETTERS or sure >= DOUBT)


def segment_batch(model: Model, texts: list[str]) -> list[list[tuple[int, int, str, float, int]]]:
    """(start, end, language, confidence, letters) of the segments of each text; a text without letters has none."""
    lowered = [masked(t) for t in texts]
    # a letter whose lower case is two letters stays, so positions do
    lowered = [x if len(x := t.lower()) == len(t) else "".join(y if len(y := c.lower()) == 1 else c for c in t) for t in lowered]
    spans = [_breaks(t) for t in lowered]
    codes = [_codes(t) for t in lowered]
    sizes = np.array([len(c) for c in codes], np.int64)
    flat = np.concatenate(codes) if len(codes) else np.zeros(0, np.uint32)
    if not len(flat):
        return [[] for _ in texts]
    live = LETTER[flat]
    value = np.zeros((len(flat), model.weights.shape[1]), np.float32)
    at = np.flatnonzero(live)
    for h in hashes(flat):
        value[at] += model.weights[h[at]]
    base = np.cumsum(sizes) - sizes
    ends = np.concatenate([b + s for b, s in zip(base, spans)])
    owner = np.repeat(np.arange(len(texts)), [len(s) for s in spans])
    starts = np.r_[0, ends[:-1]]
    letters = np.r_[0, np.cumsum(live)]
    n = letters[ends] - letters[starts]
    # reduceat wants starts below the length; empty spans get no letters anyway
    sums = np.add.reduceat(value, np.minimum(starts, len(flat) - 1), axis=0)
    sums[n == 0] = 0
    score = model.scores(sums / np.maximum(n, 1)[:, None])
    weight = np.minimum(n / LETTER_EVIDENCE, 1.0).astype(np.float32)
    first = np.searchsorted(owner, np.arange(len(texts)))
    last = np.searchsorted(owner, np.arange(len(texts)), "right")
    out: list[list[tuple[int, int, str, float, int]]] = []
    for k in range(len(texts)):
        rows = np.arange(first[k], last[k])
        rows = rows[n[rows] > 0]
        if not len(rows):
            out.append([])
            continue
        path = _path(score[rows], weight[rows], SWITCH)
        cuts = np.flatnonzero(np.r_[True, path[1:] != path[:-1]])
        runs = [(rows[a:b], int(path[a])) for a, b in zip(cuts, [*cuts[1:], len(rows)])]
        if len(runs) > 1:
            solid = [r for r in runs if _solid(n[r[0]].sum(), model.langs[r[1]], _sure(score, weight, r))]
            solid = solid or [max(runs, key=lambda r: n[r[0]].sum())]
            merged: list[tuple[np.ndarray, int]] = []
            for r in runs:
                if any(r is s for s in solid) and not (merged and merged[-1][1] == r[1]):
                    merged.append(r)
                elif merged:
                    merged[-1] = (np.r_[merged[-1][0], r[0]], merged[-1][1])
                else:
                    merged.append((r[0], solid[0][1]))
            joined: list[tuple[np.ndarray, int]] = []
            for r in merged:
                if joined and joined[-1][1] == r[1]:
                    joined[-1] = (np.r_[joined[-1][0], r[0]], r[1])
                else:
                    joined.append(r)
            runs = joined
        found = []
        for j, (own, lang) in enumerate(runs):
            p = _sure(score, weight, (own, lang))
            a = 0 if j == 0 else int(starts[own[0]] - base[k])
            b = int(sizes[k]) if j == len(runs) - 1 else int(starts[runs[j + 1][0][0]] - base[k])
            found.append((a, b, model.langs[lang], round(p, 4), int(n[own].sum())))
        out.append(found)
    return out


def fit(samples: DataFrame, lang: str = "lang", text: str = "text", rows: int = SAMPLE_ROWS) -> Model:
    """Fit the machines on a bounded sample of labelled sentences: the ``rows`` smallest by hash."""
    part = samples.where(F.col(text).isNotNull() & F.col(lang).isNotNull()).select(lang, text)
    got = part.orderBy(F.xxhash64(lang, text), text, lang).limit(rows).toPandas()
    return Model(got[text].tolist(), got[lang].tolist())


def segments(df: DataFrame, key: str, text: str, model: Model) -> DataFrame:
    """(key, seg_no, start, end, lang_code, confidence, letters): the language segments of every text.

    Segments cover the text from 0 to its end in code points and alternate in language. Null, empty and blank
    texts, and texts without letters, give no rows. Every row of the input is done on its own: no shuffle.
    """
    spark = df.sparkSession
    shared = spark.sparkContext.broadcast(model)  # 2**16 weights of some 14 machines: about 4 MB, fixed
    kind = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m = shared.value
        for pdf in batches:
            part = pdf["t"].str.len().cumsum() // 300_000
            for _, own in pdf.groupby(part, sort=False):
                rows = [(k, j, *s) for k, found in zip(own["k"], segment_batch(m, own["t"].tolist())) for j, s in enumerate(found)]
                yield pd.DataFrame(rows, columns=[key, "seg_no", "start", "end", "lang_code", "confidence", "letters"])

    some = df.select(F.col(f"`{key}`").alias("k"), F.col(f"`{text}`").alias("t")).where(F.length(F.trim("t")) > 0)
    return some.mapInPandas(run, f"`{key}` {kind}, seg_no bigint, start bigint, end bigint, lang_code string, confidence double, letters bigint")
