"""Languages of documents and of their stretches, by hierarchical discrimination.

First the language family is told (one-versus-rest linear support vector
machines), then a one-versus-one machine separates the close relatives within
it. Features are hashed character n-grams inside words, so a stretch's score is
the sum of its words' scores: each distinct word is scored once per worker.
"""

from __future__ import annotations

import html
import re
import unicodedata
import zlib
from bisect import bisect_right
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioscan.operators.ranking import top_k
from folioscan.session import spread

FAMILIES = {"germanic": ["de", "en"], "romance": ["es", "fr"], "sinitic": ["zh"]}
UNKNOWN = "und"  # a stretch in none of the model's languages
# Names and codes under which a label names each language.
NAMES = {
    "en": "en eng english anglais englisch inglés ingles inglese 英语 英文",
    "fr": "fr fre fra french français francais französisch franzoesisch francés frances 法语 法文",
    "de": "de ger deu german deutsch allemand alemán aleman 德语 德文",
    "es": "es spa spanish español espanol castellano espagnol spanisch 西班牙语 西班牙文",
    "zh": "zh chi zho cmn chinese mandarin chinois chinesisch chino 中文 汉语 漢語 华语 普通话 简体中文",
}
CODE = {unicodedata.normalize("NFC", n): c for c, names in NAMES.items() for n in names.split()}
MIN_WORDS, MIN_HAN = 25, 40
FURNITURE = 5  # so few words (a copyright line, a note of the archive) do not make a second language

_TAG = re.compile(r"</?[A-Za-z][^<>]{0,200}>")
_MATH = re.compile(r"\$\$[^$]{0,2000}\$\$|\$[^$\n]{0,400}\$|\\\[.{0,2000}?\\\]|\\\(.{0,400}?\\\)", re.S)
_CITED = re.compile(r"\[\d{1,4}\][^\n.\[\]]{0,300}?,\s*(?:1[5-9]|20)\d\d\b\.?")
_NOISE = re.compile(r"https?://\S+|\S+@\S+|\\[A-Za-z]+")
_ENTITY = re.compile(r"&(?:#[0-9]+|#[xX][0-9a-fA-F]+|[A-Za-z][A-Za-z0-9]*);?")
_MOJIBAKE = re.compile("[Â-ô][\u0080-¿]{1,3}")
_SENTENCE = re.compile(r"[^.!?;\n。！？]+[.!?;\n。！？]*")
_TOKEN = re.compile(r"[㐀-䶿一-鿿]|[^\W\d_㐀-䶿一-鿿]+(?:['’-][^\W\d_㐀-䶿一-鿿]+)*")
_RUN = re.compile(r"[㐀-䶿一-鿿]+(?:[^\w]*[㐀-䶿一-鿿]+)*|[^㐀-䶿一-鿿]+")


def label_code(label: str | None, codes: dict[str, str] = CODE) -> str | None:
    """The language a label names, or None; ``en-US``, ``German`` and ``中文`` name one."""
    if label is None:
        return None
    name = unicodedata.normalize("NFC", label).strip().lower()
    return codes.get(name) or codes.get(re.split(r"[-_]", name)[0])


def _unbroken(match: re.Match) -> str:
    try:
        return match[0].encode("latin-1").decode("utf-8")
    except UnicodeError:
        return match[0]


def _entity(match: re.Match) -> str:
    return html.unescape(match[0])


class Places:
    """Places of a mended text in the original: pairs of starts, in both, from which on the texts run side by side."""

    def __init__(self) -> None:
        self.passes: list[tuple[list[int], list[int]]] = []

    def mend(self, text: str, pattern: re.Pattern, repair) -> str:
        out, new, old = [], [0], [0]
        at = size = 0
        for m in pattern.finditer(text):
            made = repair(m)
            if made == m[0]:
                continue
            out += [text[at : m.start()], made]
            size += m.start() - at
            new += [size, size + len(made)]
            old += [m.start(), m.end()]
            size, at = size + len(made), m.end()
        if at:
            self.passes.append((new, old))
            text = "".join([*out, text[at:]])
        return text

    def original(self, place: int) -> int:
        for new, old in reversed(self.passes):
            i = bisect_right(new, place) - 1
            place = min(old[i] + place - new[i], old[i + 1] if i + 1 < len(old) else place + old[i])
        return place


def _blank(match: re.Match) -> str:
    """As many blanks as the match is long, so that places in the text stay."""
    return " " * len(match[0])


def running_text(text: str) -> tuple[str, Places]:
    """The text with mark-up, formulas, cited titles and addresses blanked and broken encoding mended, and its places."""
    places = Places()
    if "&" in text:
        text = places.mend(text, _ENTITY, _entity)
    if not text.isascii():
        text = places.mend(text, _MOJIBAKE, _unbroken)
    for pattern in (_TAG, _MATH, _CITED, _NOISE):
        text = pattern.sub(_blank, text)
    return text, places


def fold(word: str) -> str:
    """Case and accents are not kept, since many texts have lost them."""
    if word.isascii():
        return word.lower()
    return "".join(c for c in unicodedata.normalize("NFKD", word.lower()) if not unicodedata.combining(c))


class Model:
    """Linear machines over hashed character n-grams: one for each family, one for each pair within a family.

    ``families`` name the languages. ``seen`` marks the words of each language's
    sample; of a stretch in a further language few are marked.
    """

    def __init__(self, families: dict[str, list[str]] = FAMILIES, buckets: int = 1 << 13, words: int = 1 << 17):
        self.families = families
        self.languages = sorted(x for f in families.values() for x in f)
        self.buckets = buckets
        self.pairs = [p for f in families.values() for p in combinations(f, 2)]
        self.columns = len(families) + len(self.pairs)
        self.weights = np.zeros((buckets, self.columns), dtype=np.float32)
        self.bias = np.zeros(self.columns, dtype=np.float32)
        self.slope = np.ones(self.columns)
        self.seen = np.zeros((words, len(self.languages)), dtype=bool)
        self.least_seen = 0.0  # share of marked words below which a stretch is in no language of the model

    def word(self, word: str) -> int:
        return zlib.crc32(fold(word).encode()) % len(self.seen)

    def _fit_words(self, samples: list[tuple[list[str], str]], held: list[int]) -> None:
        """Marks the words of the samples; the held-out ones, by the others' words, tell how many a stretch has."""
        apart, shares = set(held), []
        for k, (tokens, code) in enumerate(samples):
            if k not in apart:
                self.seen[[self.word(t) for t in tokens], self.languages.index(code)] = True
        for k in held:
            tokens, code = samples[k]
            if len(tokens) >= 8:
                shares.append(self.seen[[self.word(t) for t in tokens], self.languages.index(code)].mean())
        for k in held:
            tokens, code = samples[k]
            self.seen[[self.word(t) for t in tokens], self.languages.index(code)] = True
        self.least_seen = float(np.percentile(shares, 1)) / 2 if len(shares) >= 100 else 0.0

    def grams(self, word: str) -> np.ndarray:
        w = f"^{fold(word)}$"
        return np.array([zlib.crc32(w[i : i + n].encode()) % self.buckets for n in (2, 3, 4) for i in range(len(w) - n + 1)] or [0])

    def features(self, tokens: list[str]) -> tuple[np.ndarray, np.ndarray]:
        ids, counts = np.unique(np.concatenate([self.grams(t) for t in tokens]), return_counts=True)
        values = counts.astype(np.float32)
        return ids, values / np.sqrt((values**2).sum())

    def fit(self, samples: list[tuple[list[str], str]], vectors: list, epochs: int = 4, decay: float = 1e-4, seed: int = 7) -> None:
        """Hinge loss by stochastic subgradients; every fifth sample is held out to calibrate the margins."""
        family = {c: i for i, f in enumerate(self.families.values()) for c in f}
        n_families = len(self.families)
        targets = np.zeros((len(samples), self.columns), dtype=np.float32)
        for k, (_, code) in enumerate(samples):
            targets[k, :n_families] = -1
            targets[k, family[code]] = 1
            for j, (a, b) in enumerate(self.pairs):
                targets[k, n_families + j] = 1 if code == a else -1 if code == b else 0
        order = np.random.default_rng(seed)
        kept = np.array([k for k in range(len(samples)) if k % 5 or len(samples) < 50])
        self.weights[:], self.bias[:] = 0, 0
        step = 0
        for _ in range(epochs):
            for k in order.permutation(kept):
                step += 1
                rate = np.float32(1 / (1 + decay * 50 * step))
                ids, values = vectors[k]
                margin = values @ self.weights[ids] + self.bias
                push = np.where(targets[k] * margin < 1, targets[k], 0).astype(np.float32) * rate
                if push.any():
                    self.weights[ids] += values[:, None] * push
                    self.bias += 0.05 * push
        held = [k for k in range(len(samples)) if not k % 5] or list(kept)
        margins = np.array([vectors[k][1] @ self.weights[vectors[k][0]] + self.bias for k in held]) if held else np.zeros((0, self.columns))
        for j in range(self.columns):
            use = targets[held, j] != 0 if held else np.zeros(0, bool)
            if use.any():
                y = (targets[held, j][use] > 0).astype(float)
                m = margins[use, j]
                grid = [0.25, 0.5, 1, 2, 3, 4, 6, 8]
                loss = [-np.mean(y * -np.logaddexp(0, -s * m) + (1 - y) * -np.logaddexp(0, s * m)) for s in grid]
                self.slope[j] = grid[int(np.argmin(loss))]
        self.seen[:] = False
        self._fit_words(samples, held)

    def decide(self, margins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Language index and confidence for each row of margins: family first, then the pairs within it."""
        prob = 1 / (1 + np.exp(-np.clip(margins * self.slope, -30, 30)))
        nf = len(self.families)
        fam = prob[:, :nf] / np.maximum(prob[:, :nf].sum(1, keepdims=True), 1e-9)
        scores = np.zeros((len(margins), len(self.languages)))
        for i, codes in enumerate(self.families.values()):
            for c in codes:
                within = np.ones(len(margins))
                for j, (a, b) in enumerate(self.pairs):
                    if c == a:
                        within = within * prob[:, nf + j]
                    elif c == b:
                        within = within * (1 - prob[:, nf + j])
                scores[:, self.languages.index(c)] = fam[:, i] * within
        best = fam.argmax(1)
        inside = np.array([[c in codes for c in self.languages] for codes in self.families.values()])
        choice = np.where(inside[best], scores, -1).argmax(1)
        return choice, scores[np.arange(len(margins)), choice]


class Labeller:
    """Applies a model to many texts; keeps the scores of words it has met, up to ``most`` of them."""

    def __init__(self, model: Model, most: int = 200_000):
        self.model, self.most = model, most
        self.known: dict[str, int] = {}
        self.rows: list[np.ndarray] = []

    def _id(self, word: str) -> int:
        at = self.known.get(word)
        if at is None:
            ids = self.model.grams(word)
            at = self.known[word] = len(self.rows)
            seen = self.model.seen[self.model.word(word)].astype(np.float32)
            self.rows.append(np.concatenate((self.model.weights[ids].sum(0), [np.float32(len(ids))], seen)))
        return at

    def pieces(self, text: str) -> list[tuple[int, int, int, list[str]]]:
        """``start, end, script, tokens`` of each sentence's runs of one script (1: Han)."""
        clean, places = running_text(text)
        out = []
        for sentence in _SENTENCE.finditer(clean):
            for run in _RUN.finditer(sentence[0]):
                tokens = _TOKEN.findall(run[0])
                if tokens:
                    han = int("㐀" <= tokens[0] <= "鿿")
                    first = len(run[0]) - len(run[0].lstrip())
                    ends = sentence.start() + run.start() + first, sentence.start() + run.end()
                    out.append((places.original(ends[0]), places.original(ends[1]), han, tokens))
        return out

    @staticmethod
    def _near(pieces: list[dict], i: int) -> dict | None:
        """The nearest piece that is not weak, one in letters before one in Han."""
        strong = [(p["lang"] == "zh", abs(j - i), j) for j, p in enumerate(pieces) if not p["weak"]]
        return pieces[min(strong)[2]] if strong else None

    def label(self, texts: list[str]) -> list[list[dict]]:
        """For each text its stretches: ``start, end, lang, conf, words``, neighbours of one language merged."""
        if len(self.rows) > self.most:
            self.known, self.rows = {}, []
        parts = [self.pieces(t) for t in texts]
        ids = [self._id(w) for ps in parts for p in ps for w in p[3]]
        if not ids:
            return [[] for _ in texts]
        lengths = np.array([len(p[3]) for ps in parts for p in ps])
        sums = np.add.reduceat(np.array(self.rows)[ids], np.concatenate(([0], np.cumsum(lengths)[:-1])))
        c = self.model.columns
        margins = sums[:, :c] / np.sqrt(np.maximum(sums[:, c : c + 1], 1)) + self.model.bias
        choice, conf = self.model.decide(margins)
        out, k = [], 0
        for ps in parts:
            merged: list[dict] = []
            for start, end, han, tokens in ps:
                piece = {"start": start, "end": end, "lang": self.model.languages[choice[k]], "conf": float(conf[k])}
                seen = float(sums[k, c + 1 + choice[k]])
                k += 1
                merged.append(piece | {"words": len(tokens), "weak": not han and len(tokens) < 4, "seen": seen, "of": len(tokens)})
            for i, piece in enumerate(merged):  # a few words alone tell little: they go with their neighbours
                if piece["weak"]:
                    near = self._near(merged, i)
                    if near:
                        piece["lang"] = near["lang"]
                        piece["words"] = 0 if near["lang"] == "zh" else piece["words"]
            runs: list[dict] = []
            for piece in merged:
                piece.pop("weak")
                if runs and runs[-1]["lang"] == piece["lang"]:
                    last = runs[-1]
                    total = last["words"] + piece["words"]
                    if piece["words"]:
                        last["conf"] = (last["conf"] * last["words"] + piece["conf"] * piece["words"]) / total
                    last["end"], last["words"] = piece["end"], total
                    last["seen"], last["of"] = last["seen"] + piece["seen"], last["of"] + piece["of"]
                else:
                    runs.append(piece)
            for run in runs:
                seen, of = run.pop("seen"), run.pop("of")
                if of >= MIN_WORDS and seen < self.model.least_seen * of:
                    run["lang"], run["conf"] = UNKNOWN, 1 - seen / of
            out.append(runs)
        return out


def counted(stretches: list[dict]) -> dict[str, tuple[int, float]]:
    """``lang -> (words, confidence)`` of the languages that count for a document."""
    total: dict[str, list[float]] = {}
    for s in stretches:
        t = total.setdefault(s["lang"], [0, 0.0])
        t[0] += s["words"]
        t[1] += s["conf"] * s["words"]
    present = {c for c, (n, _) in total.items() if n > FURNITURE} or {max(total, key=lambda c: total[c][0])} if total else set()
    return {c: (int(n), x / max(n, 1)) for c, (n, x) in total.items() if n >= (MIN_HAN if c == "zh" else MIN_WORDS) or present == {c}}


def train(documents: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", per_language: int = 300, max_chars: int = 4000, rounds: int = 2, families: dict[str, list[str]] = FAMILIES, codes: dict[str, str] = CODE) -> Model:
    """Fit the machines for the languages of ``families`` on a bounded sample of labelled rows.

    Of each language at most ``per_language`` documents, those with the greatest
    hash of their key, cut to ``max_chars`` (for fitting only); all sentences of
    what is left are used, in full length. Labels may be
    wrong and documents mixed: after each round, sentences that the model gives
    another language are left out of the next.
    """
    wanted = {c for f in families.values() for c in f}
    names = F.create_map(*[F.lit(x) for name, c in codes.items() if c in wanted for x in (name, c)])
    low = F.lower(F.trim(F.col(lang)))
    code = F.coalesce(names[low], names[F.regexp_extract(low, "^([^-_]*)", 1)])
    rows = documents.filter(F.col(text).isNotNull() & F.col(lang).isNotNull()).select(F.col(key).alias("k"), F.substring(text, 1, max_chars).alias("t"), code.alias("c")).filter("c IS NOT NULL")
    samples: list[tuple[list[str], str]] = []
    model = Model(families)
    probe = Labeller(model)
    # At most per_language rows of each language come to the driver; the engine cuts before the shuffle.
    sample = top_k(rows.withColumn("h", F.xxhash64("k")), per_language, ["c"], "h", "t")
    for r in sorted(sample.collect(), key=lambda r: (r.c, r["rank"])):
        for _, _, han, tokens in probe.pieces(r.t):
            if bool(han) == (r.c == "zh") and len(tokens) >= 4:
                samples.append((tokens, r.c))
    if not samples:
        return model
    vectors = [model.features(t) for t, _ in samples]
    for n in range(rounds):
        model.fit(samples, vectors)
        if n + 1 < rounds:
            choice, _ = model.decide(np.array([v @ model.weights[i] + model.bias for i, v in vectors]))
            agreed = [k for k, c in enumerate(choice) if model.languages[c] == samples[k][1]]
            if agreed:
                samples, vectors = [samples[k] for k in agreed], [vectors[k] for k in agreed]
    return model


SCHEMA = "doc_id bigint, label_code string, stretches array<struct<start:int,end:int,lang:string,conf:double,words:int>>, languages array<struct<lang:string,words:int,conf:double>>"


def detect_languages(documents: DataFrame, model: Model | None = None, key: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """One row per document row: what its label names, its stretches, and the languages that count.

    A language counts with at least 25 words (40 characters of Chinese) of
    running text, or if it is the document's only one. ``start`` and ``end`` of a
    stretch count in the text as it was given. A stretch of 25 words or more of
    which hardly any occur in the samples is of no language of the model (``und``);
    near relatives of those languages may pass for them. Cases: null, empty and
    wordless texts have no stretches and no languages; a null, unknown or
    meaningless label names nothing; repeated rows give repeated rows; an empty
    table gives none; other columns are ignored.
    """
    spark = documents.sparkSession
    shared = spark.sparkContext.broadcast(model or train(documents, key, text, lang))  # under 1 MB, whatever the input

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        labeller = Labeller(shared.value)
        for batch in batches:
            for low in range(0, len(batch), 500):
                part = batch.iloc[low : low + 500]
                stretches = labeller.label([t or "" for t in part["t"]])
                yield pd.DataFrame({"doc_id": part["k"].to_numpy(), "label_code": [label_code(x) for x in part["c"]], "stretches": stretches, "languages": [[{"lang": c, "words": n, "conf": x} for c, (n, x) in sorted(counted(s).items())] for s in stretches]})

    rows = documents.filter(F.col(key).isNotNull()).select(F.col(key).cast("bigint").alias("k"), F.col(text).alias("t"), F.col(lang).alias("c"))
    return spread(rows).mapInPandas(run, SCHEMA)


def mislabelled(detected: DataFrame) -> DataFrame:
    """``doc_id, lang_code, confidence``: each language that counts in a document that is mixed, unlabelled or labelled as another."""
    own = F.element_at("languages", 1)["lang"]
    wrong = (F.size("languages") > 1) | ((F.size("languages") == 1) & ~F.col("label_code").eqNullSafe(own))
    return detected.filter(wrong).select("doc_id", F.explode("languages").alias("l")).groupBy("doc_id", F.col("l.lang").alias("lang_code")).agg(F.max("l.conf").alias("confidence"))
