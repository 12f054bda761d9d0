"""URL filter: rules for hosts and paths, and a logistic regression on hashed character n-grams for the rest.

The model is trained on a small labelled table of addresses, made by rule; a rule, where one fits, goes before it. The
score from which on an address is blocked follows from hosts that the model hasn't seen.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import slice_hashes, table, text_bytes

#: (verdict, host, path)
RULES = [
    ("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"), ("block", "com", "/de/"),
]

#: What addresses to block and ordinary ones are about.
BLOCKED = "casino poker jackpot slots betting lottery roulette viagra cialis pills pharma xxx porn adult cams escort dating loan payday crack warez keygen torrent replica cheap free spam ads track popup click bonus prize".split()
ALLOWED = "news library museum school weather garden science history recipes travel journal forum health sport music books nature theory city wiki teacher radio maps docs market bakery hotel bank church football painting kitchen river".split()
#: Syllables of the names that neither list knows.
SYLLABLES = "an ar be ca con de di en er es fo ge ha in is ka la le lin lo ma me mer mi mo na ne no on or pa pe po ra re ri ro sa se si so sta ta te ter th ti tion to tra un ur ve vi wa wel".split()
#: Hosts of ordinary and of blocked addresses: n is a made-up name, w a word of the list, e its end.
HOSTS = ("{n}{e}", "{n}{e}", "{n}{e}", "{n}-{m}{e}", "{w}{e}", "{w}-{n}{e}", "{n}{w}{e}", "{n}.example{e}")
BAD_HOSTS = ("{w}-{v}{e}", "{w}-{n}{e}", "{n}-{w}{e}", "{n}{w}{e}", "{w}{n}{e}", "{w}{e}", "{w}-{v}.example{e}", "{v}{w}.{n}{e}")
FRONTS, ENDS = ("", "www.", "m.", "blog.", "shop.", "my."), (".com", ".org", ".net", ".test", ".co.uk", ".de", ".info")
PATHS = ("/", "", "/{k}", "/en/{k}", "/de/{k}.html", "/fr/{k}/", "/es/{k}", "/{m}/{k}", "/{m}-{n}/{k}.html", "/index.html", "/20/{k}/{m}", "/{w}/{k}")
#: Ordinary and blocked addresses of the labelled table, and the share of held-out ordinary hosts that may be blocked.
N_ALLOWED, N_BLOCKED, FALSE_BLOCKS = 2_400, 1_200, 0.01


def _draw(*what: object) -> int:
    return xxhash.xxh64_intdigest(":".join(map(str, what)))


def made_up(*what: object) -> str:
    """A name of two or three syllables."""
    return "".join(SYLLABLES[_draw(k, *what) % len(SYLLABLES)] for k in range(2 + _draw("size", *what) % 2))


def labelled_table(allowed: int = N_ALLOWED, blocked: int = N_BLOCKED) -> list[tuple[str, int]]:
    """(url, 1 to block or 0 to allow), by rule: made-up names and the same fronts, ends and paths in both classes, so that
    only what an address is about tells them apart; most ordinary hosts hold no word of either list."""
    out = []
    for y, n, words, hosts in ((0, allowed, ALLOWED, HOSTS), (1, blocked, BLOCKED, BAD_HOSTS)):
        for i in range(n):
            pick = lambda of, what, i=i, y=y: of[_draw(what, y, i) % len(of)]
            fill = {"n": made_up("n", y, i), "m": made_up("m", y, i), "w": pick(words, "w"), "v": pick(words, "v"), "e": pick(ENDS, "e"), "k": _draw("k", y, i) % 10_000}
            path = pick(PATHS, "path").format(**fill | ({} if y == 0 or _draw("own", i) % 2 else {"w": fill["n"]}))
            out.append((("http://", "https://")[_draw("s", y, i) % 2] + pick(FRONTS, "front") + pick(hosts, "host").format(**fill) + path, y))
    return out


#: Hashed dimensions (a power of two), sizes of n-grams, and what each counts; the same in short and long addresses.
BITS, SIZES, EACH = 16, (3, 4, 5), 0.1
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_URL = r"(?s)^.*?://([^/?#]*)([^?#]*)"


def parts(url: Column) -> tuple[Column, Column]:
    """Host (A-Z in lower case) and path; both empty for null and for what has no ://."""
    url = F.coalesce(url, F.lit(""))
    return F.translate(F.regexp_extract(url, _URL, 1), _UPPER, _LOWER), F.regexp_extract(url, _URL, 2)


def fitting_rule(host: Column, path: Column, rules: list[tuple[str, str, str]] = RULES) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits the host or a domain above it and the path's beginning; else null."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for v, h, p in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == h) | host.endswith(f".{h}")) & path.startswith(p)
        rule, verdict = F.when(fits, h + p).otherwise(rule), F.when(fits, v).otherwise(verdict)
    return rule, verdict


def features(texts: pa.Array, bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """(row, index) of each hashed character n-gram (of bytes) of the given strings."""
    data, at = text_bytes(texts)
    rows, found = [], []
    of = np.repeat(np.arange(len(at) - 1), np.diff(at))
    for n in SIZES:
        starts = np.arange(max(0, len(data) - n + 1))
        starts = starts[of[starts] == of[starts + n - 1]] if len(starts) else starts
        rows.append(of[starts])
        found.append((slice_hashes(data, starts, starts + n) >> np.uint64(64 - bits)).astype(np.int64))
    return np.concatenate(rows), np.concatenate(found)


def keyed(host: Column, path: Column) -> Column:
    """What the model reads: host and path with marks for their ends."""
    return F.concat(F.lit("^"), host, F.lit("|"), path, F.lit("$"))


def scores(texts: pa.Array, weights: np.ndarray, bias: float) -> np.ndarray:
    row, k = features(texts)
    z = np.bincount(row, weights[k], len(texts)) * EACH + bias
    return 1 / (1 + np.exp(-np.clip(z, -500, 500)))


def train(texts: list[str], labels: list[int], rounds: int = 400, rate: float = 12.0, decay: float = 1e-6) -> tuple[np.ndarray, float]:
    """Logistic regression by accelerated gradient descent, classes weighing the same; the table is small and given, so
    this runs where it is. Rows are about as long as one, so the loss is smooth enough for the rate."""
    row, k = features(pa.array(texts))
    y = np.array(labels, float)
    share = float(np.clip(y.mean(), 0.01, 0.99)) if len(y) else 0.5
    weight = np.where(y > 0, 0.5 / share, 0.5 / (1 - share)) / max(1, len(y))
    w, past, b, b_past = np.zeros(1 << BITS), np.zeros(1 << BITS), 0.0, 0.0
    for _ in range(rounds):
        ahead = w + 0.9 * past
        p = 1 / (1 + np.exp(-(np.bincount(row, ahead[k], len(texts)) * EACH + b + 0.9 * b_past)))
        g = weight * (p - y)
        past = 0.9 * past - rate * (np.bincount(k, g[row], len(w)) * EACH + decay * ahead)
        b_past = 0.9 * b_past - rate * g.sum()
        w, b = w + past, b + b_past
    return w, b


def threshold(score: np.ndarray, y: np.ndarray, false_blocks: float = FALSE_BLOCKS) -> float:
    """The smallest score from which on at most the given share of ordinary addresses is blocked."""
    ordinary = np.sort(score[y == 0])
    k = int(np.ceil(len(ordinary) * (1 - false_blocks))) - 1
    return float(np.nextafter(ordinary[k], 1)) if len(ordinary) else 0.5


def fitted(rows: list[tuple[str, str, int]], false_blocks: float = FALSE_BLOCKS) -> tuple[np.ndarray, float, float]:
    """(weights, bias, threshold) from rows of (what the model reads, host, label).

    A quarter of the hosts is held out: the threshold comes from a model that hasn't seen them; the weights from all.
    """
    y = np.array([r[2] for r in rows], int)
    out = np.array([_draw("fold", r[1]) % 4 == 0 for r in rows], bool)
    at = 0.5
    if out.any() and not out.all():
        weights, bias = train([r[0] for r, o in zip(rows, out, strict=True) if not o], y[~out].tolist())
        at = threshold(scores(pa.array([r[0] for r, o in zip(rows, out, strict=True) if o]), weights, bias), y[out], false_blocks)
    return *train([r[0] for r in rows], y.tolist()), at


def judge(pages: DataFrame, rules: list[tuple[str, str, str]] = RULES, labelled: list[tuple[str, int]] | None = None, false_blocks: float = FALSE_BLOCKS) -> DataFrame:
    """(page_id, host, path, rule, verdict, score) for each row of ``pages``.

    Null urls and those without :// have empty host and path, fit no rule and are judged by the model; urls of any length
    are read whole. Repeated rows are judged each. Further columns of ``pages`` aren't read, so their names don't matter.
    An empty table gives an empty result.
    """
    given = pages.sparkSession.createDataFrame(labelled_table() if labelled is None else labelled, "url string, y int")
    host, path = parts(F.col("url"))
    rows = given.select(keyed(host, path).alias("x"), host.alias("host"), "y").collect()  # the small labelled table
    weights, bias, at = fitted([(r.x, r.host, r.y) for r in rows], false_blocks)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns[:5], pa.array(scores(b.column(5), weights, bias))], ["page_id", "host", "path", "rule", "told", "score"])

    split = pages.select(F.col("page_id").cast("long"), host.alias("host"), path.alias("path"))
    rule, told = fitting_rule(F.col("host"), F.col("path"), rules)
    ruled = split.select("page_id", "host", "path", rule.alias("rule"), told.alias("told"), keyed(F.col("host"), F.col("path")).alias("x"))
    scored = ruled.mapInArrow(run, "page_id long, host string, path string, rule string, told string, score double")
    verdict = F.coalesce("told", F.when(F.col("score") >= at, "block").otherwise("allow"))
    return scored.select("page_id", "host", "path", "rule", verdict.alias("verdict"), "score")


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdict on every page's address."""
    return judge(table(spark, sf_dir, "pages"))
