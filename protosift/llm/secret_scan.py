"""Secrets in text: fixed patterns, and random-looking strings by Markov models.

Two character models of second order are trained from labelled samples: random
strings, which are the values the patterns find and made ones, and ordinary
identifiers, which are the other words and identifiers made of words. A run of token characters is a secret too if its
log-likelihood ratio per character, random against ordinary, exceeds a
threshold that is fitted on samples held back, and it is long enough to tell. Spans
so found are added to those of the patterns.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from random import Random

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from protosift.llm.scratch import forget_in_worker, small_batches

# Patterns of the base kinds and the least lengths.
ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE
)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")
KINDS = ("assign", "access", "hex", "markov")
ASSIGN_LEAST, ACCESS_LEAST = 12, 18

#: Characters of the models; every other one ends a run.
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
LEAST_RUN = 16
RUN = re.compile(rf"[A-Za-z0-9+/_=-]{{{LEAST_RUN},}}")
#: Words that are samples of ordinary text.
WORD = re.compile(r"[A-Za-z0-9+/_=-]{4,}")
#: Documents that give samples, as a rule at most, characters of each (a part of the
#: text that a hash picks), and characters of a sample.
SAMPLE_ROWS = 3000
SAMPLE_CHARS = 2000
VALUE_CHARS = 256
#: Labelled strings that are made, of each kind of label.
MADE = 6000
#: Share of ordinary identifiers that may be marked, on samples the models have not seen.
FALSE_SHARE = 0.002

# Common words of identifiers, as samples for their labels.
IDENTIFIER_WORDS = """
access account action active add address admin agent alert all amount api app apply archive args array asset async attempt
audio auth author auto available backup base batch begin bin block body bool boot branch buffer build bundle button byte
cache call callback cancel card case category cell center change channel char check child class clean client clone close
cluster code color column command comment commit common compare compile complete component config connect connection
console constant content context control convert copy core cost count cpu create credit current custom data database date
day debug default define delete deploy detail device dialog digest dir disable display document domain download driver
edge edit element email enable encode end engine entry enum environment error event example exception execute exist exit
expire export extension factory fail feature fetch field file filter find first flag flow folder font format found frame
function gateway generic get global graph group guest handler hash header health height help history home host hour html
http icon image import include index info init input insert install integer interface internal invalid item iterator java
job join json kernel key kind label last layer layout level library limit line link list listener load local lock log
login main manager map mask master match max memory menu merge message meta method metric min mode model module monitor
month mount move name namenode network new next node not number object offset open operator option order output owner
package page param parent parse part password path pattern payload payment permission phone pipeline platform player
point policy pool port post prefix previous price print private process product profile project property protocol proxy
public pull push query queue random range rate read ready record redirect reference region register release remote remove
render repeat replace report request reset resource response result retry return role root route row rule run sample
save schedule schema screen script search second section security select send server service session set setting shared
shell show sign simple size sleep socket sort source split stack stage start state static status step stop storage store
stream string style submit success summary support switch sync system table tag target task team template temp test text
thread time timeout title token tool total trace track transaction transfer tree trigger type undo unique unit update
upload url user utils valid value vector verify version video view virtual wait warning watch web width window wrapper
write xml year zone
""".split()

Span = tuple[int, int, int]


def base_spans(text: str) -> list[Span]:
    """(start, kind number, end) by start, then kind, in code points."""
    spans = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= ASSIGN_LEAST]
    if "AKIA" in text:
        spans += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= ACCESS_LEAST]
    spans += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(spans)


_CODE = np.full(128, -1, np.int8)
_CODE[[ord(c) for c in ALPHABET]] = np.arange(len(ALPHABET))


def _codes(run: str) -> np.ndarray:
    return _CODE[np.frombuffer(run.encode("ascii"), np.uint8)]


@dataclass
class MarkovModels:
    """Log-likelihood ratio of every character after two others, and the mean ratio
    from which on a run is random."""

    ratios: np.ndarray
    threshold: float = 0.0

    @staticmethod
    def fit(random: list[str], ordinary: list[str]) -> MarkovModels:
        n = len(ALPHABET)

        def likelihood(strings: list[str], flat: float) -> np.ndarray:
            c = _codes(" ".join(strings)).astype(np.int64)
            here = [c >= 0, (c[:-1] >= 0) & (c[1:] >= 0), (c[:-2] >= 0) & (c[1:-1] >= 0) & (c[2:] >= 0)]
            grams = [c, c[:-1] * n + c[1:], (c[:-2] * n + c[1:-1]) * n + c[2:]]
            singles, pairs, triples = (
                np.bincount(g[k], minlength=n ** (i + 1)).astype(float).reshape((n,) * (i + 1))
                for i, (g, k) in enumerate(zip(grams, here, strict=True))
            )
            one = (singles + flat) / (singles.sum() + flat * n)
            two = (pairs + 4 * one) / (pairs.sum(axis=1, keepdims=True) + 4)
            return (triples + 4 * two[None]) / (triples.sum(axis=2, keepdims=True) + 4)

        # Random strings of one kind may use few characters; a large flat share
        # stands for the other kinds, where any character may follow any.
        flat = max(1.0, sum(map(len, random)) / n)
        return MarkovModels(np.log(likelihood(random, flat)) - np.log(likelihood(ordinary, 1.0)))

    def ratio(self, run: str) -> float:
        """Mean log-likelihood ratio of the characters from the third on."""
        c = _codes(run)
        return float(self.ratios[c[:-2], c[1:-1], c[2:]].mean()) if len(c) > 2 else 0.0


def _judged(run: str) -> bool:
    """A run with a letter. Long runs of digits alone are hexadecimal already."""
    return any(c.isalpha() for c in run)


def _styled(words: list[str], draw: Random) -> str:
    """Words as an identifier of one of many styles."""

    def number(n: int) -> str:
        return "".join(draw.choices("0123456789", k=n))

    style = draw.randrange(14)
    if style < 2:
        return "_".join(words)
    if style == 2:
        return "_".join(words).upper()
    if style == 3:
        return "-".join(words)
    if style == 4:
        return "".join([words[0], *(w.capitalize() for w in words[1:])])
    if style == 5:
        return "".join(w.capitalize() for w in words)
    if style == 6:
        return "/".join(words)
    if style == 7:
        return f"{'_'.join(words)}_{number(draw.randint(1, 4))}"
    if style == 8:
        return "".join([words[0], *(w.capitalize() for w in words[1:])]) + number(draw.randint(1, 3))
    if style == 9:
        return f"{'-'.join(words)}-{draw.randrange(10)}-{draw.randrange(30)}-{draw.randrange(30)}"
    if style == 10:
        return f"{words[0]}-{draw.randint(1950, 2049)}-{draw.randint(1, 12):02d}-{draw.randint(1, 28):02d}-{words[-1]}"
    if style == 11:
        digits = "".join(draw.choices("0123456789abcdef", k=32))
        whole = "-".join((digits[:8], digits[8:12], digits[12:16], digits[16:20], digits[20:]))
        return whole.upper() if draw.randrange(3) == 0 else whole
    if style == 12:
        return f"{number(3)}-{number(1)}-{number(3)}-{number(5)}-{number(1)}"
    return f"{'/'.join(words)}/{words[0]}{number(draw.randint(1, 3))}"


def identifiers(words: list[str], count: int, seed: int) -> list[str]:
    """Ordinary identifiers: in two of three cases of common words, else of given ones."""
    draw, out = Random(seed), []
    plain = [w.lower() for w in words if w.isalpha()] or IDENTIFIER_WORDS
    while len(out) < count:
        source = IDENTIFIER_WORDS if draw.randrange(3) else plain
        out.append(_styled(draw.choices(source, k=draw.randint(2, 5)), draw))
    return out


def random_strings(count: int, seed: int) -> list[str]:
    """Strings of random characters, of the alphabets that keys are written in."""
    draw = Random(seed)
    letters, digits = ALPHABET[:52], ALPHABET[52:62]
    kinds = [letters + digits, letters + digits + "+/", letters + digits + "_-", letters[26:] + digits, letters[:26] + digits]
    return ["".join(draw.choices(kinds[i % len(kinds)], k=draw.randint(LEAST_RUN, 48))) for i in range(count)]


class SecretScan:
    """Finds spans of secrets in whole texts.

    Null texts count as empty and have no spans. Spans are code points of the
    text, ends exclusive. Ids may be null or repeat; every row has its result.
    Other columns are not read. An empty table gives an empty result; its models
    know the made samples only.

    Models are trained on labelled strings: random are the values of the patterns in
    a sample of texts and strings of random characters; ordinary are words of the
    sample and identifiers made of words in many styles, among them paths, versions,
    dates and hexadecimal ids in groups. Half of the made strings are held back, and
    the threshold is set on them: ``false_share`` of the ordinary ones are marked at most.
    """

    def __init__(self, id_col="doc_id", text_col="text", false_share=FALSE_SHARE, sample_rows=SAMPLE_ROWS, sample_chars=SAMPLE_CHARS):
        self.id_col, self.text_col, self.false_share = id_col, text_col, false_share
        self.sample_rows, self.sample_chars = sample_rows, sample_chars

    def fit(self, docs: DataFrame) -> MarkovModels:
        """From about ``sample_rows`` documents, picked by a hash of their texts."""
        rows = docs.select(F.coalesce(F.col(self.text_col).cast("string"), F.lit("")).alias("text"))
        place = F.shiftrightunsigned(F.xxhash64(F.lit(1), "text"), 11) / F.lit(float(2**53))
        sample = rows.where(place < F.lit(self.sample_rows / max(1, rows.count()))).where("text <> ''").distinct()
        size = F.lit(self.sample_chars)
        # A part of each text, beginning anywhere in it.
        start = F.pmod(F.xxhash64(F.lit(2), "text"), F.greatest(F.lit(1), F.length("text") - size + 1)).cast("int")
        parts = sample.select(F.substring("text", start + 1, size).alias("text"))

        def strings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                random, ordinary = [], []
                for text in batch.column(0).to_pylist():
                    at = 0
                    for begin, kind, end in base_spans(text):
                        value = ASSIGN.match(text, begin).group(2) if kind == 0 else text[begin:end]
                        random.append(value.replace(".", "-")[:VALUE_CHARS])
                        ordinary += WORD.findall(text[at:begin])
                        at = max(at, end)
                    ordinary += WORD.findall(text[at:])
                # Runs that the models are to judge have no label.
                ordinary = [w for w in ordinary if len(w) < LEAST_RUN]
                both = random + ordinary
                yield pa.RecordBatch.from_arrays(
                    [pa.array(both, pa.string()), pa.array([True] * len(random) + [False] * len(ordinary))], names=["value", "random"]
                )

        # A value counts once; all together follow the bound of the sampled texts.
        found = parts.mapInArrow(strings, "value string, random boolean").distinct().orderBy("random", "value").toPandas()
        found_random, words = (found.loc[found["random"] == k, "value"].tolist() for k in (True, False))
        made_random, made = random_strings(MADE, 1), identifiers(words, MADE, 2)
        models = MarkovModels.fit(found_random + made_random[::2], words + made[::2])
        models.threshold = self._threshold(models, made_random[1::2], made[1::2])
        return models

    def _threshold(self, models: MarkovModels, random: list[str], ordinary: list[str]) -> float:
        """Half way between where ``false_share`` of ordinary runs and where ten times
        that share of random ones lie beyond, if the two are apart; else the former."""
        runs = [m.group() for x in ordinary for m in RUN.finditer(x) if _judged(m.group())]
        low = float(np.quantile([models.ratio(x) for x in runs], 1 - self.false_share))
        high = float(np.quantile([models.ratio(x) for x in random if _judged(x)], 10 * self.false_share))
        return (low + max(low, high)) / 2

    def spans_of(self, text: str, models: MarkovModels) -> list[Span]:
        """Base spans and, where no base span lies, those of random-looking runs
        and parts of runs."""
        spans = base_spans(text)
        more = []
        for m in RUN.finditer(text):
            begin, parts = m.start(), []
            for s, _, e in spans:
                if s < m.end() and begin < e:
                    parts.append((begin, s))
                    begin = e
            for begin, end in [*parts, (begin, m.end())]:
                run = text[begin:end]
                if len(run) < LEAST_RUN or not _judged(run):
                    continue
                if models.ratio(run) > models.threshold:
                    more.append((begin, 3, end))
        return sorted(spans + more)

    def scan(self, docs: DataFrame, models: MarkovModels) -> DataFrame:
        """(id, spans) of every document; spans are structs (kind, start, end)."""

        def run(batches):
            forget_in_worker()
            for batch in batches:
                found = [
                    [{"kind": KINDS[k], "start": s, "end": e} for s, k, e in self.spans_of(t, models)] if t else []
                    for t in batch.column(1).to_pylist()
                ]
                kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, kind)], names=["id", "spans"])

        small_batches(docs.sparkSession)
        rows = docs.select(F.col(self.id_col).cast("long").alias("id"), F.col(self.text_col).cast("string").alias("text"))
        return rows.mapInArrow(run, "id long, spans array<struct<kind:string,start:long,end:long>>")

    def redact(self, docs: DataFrame, models: MarkovModels, mask: str = "[SECRET]") -> DataFrame:
        """The documents with every span replaced by ``mask``; overlapping spans
        are one. All other columns stay; a null text stays null."""
        small_batches(docs.sparkSession)
        names, at = docs.columns, docs.columns.index(self.text_col)

        def run(batches):
            forget_in_worker()
            for batch in batches:
                texts = []
                for text in batch.column(at).to_pylist():
                    if text:
                        parts, done = [], 0
                        for start, _, end in self.spans_of(text, models):
                            if start >= done:
                                parts += [text[done:start], mask]
                            done = max(done, end)
                        text = "".join(parts) + text[done:]
                    texts.append(text)
                yield batch.set_column(at, names[at], pa.array(texts, batch.schema.field(at).type))

        return docs.mapInArrow(run, docs.schema)
