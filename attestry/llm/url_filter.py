"""URL filtering: rules first, then naive Bayes over the words of host names and paths.

A rule is a host suffix, a path prefix and a verdict; the longest rule that fits decides. For the other urls, the labels of the host name
are split into words by a unigram Viterbi (`cheapcasino` → `cheap casino`), the path at everything that is no letter or digit, and a
multinomial naive Bayes over these tokens decides. It learns from the urls that a rule decides, all of them.

Word counts come from all pages: the words of their titles and paths. The lexicon is a table of all of them, however many: distinct host
names ask it for the words that they may be made of, and each is split with what it found. Token statistics fall into 65,536 slots by
hash, the size of the model and all that is ever broadcast. Counting is map-side combined and a host is split once, so a host with a
third of all pages costs its rows only.

Defined results: a null url or one without `://` has an empty host and path, fits no rule, and is judged by the classes' frequencies; without any
decided url the verdict is allow. Equal scores allow. Of equally long rules a blocking one wins. Repeated rows get equal results.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from math import log

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import settle

SLOTS = 1 << 16
LONGEST = 24
_TOKEN = re.compile(r"[a-z]+|[0-9]+|[^\x00-\x7f]+")


@dataclass(frozen=True)
class Rule:
    """Fits `host` and its subdomains, where the path starts with `path`."""

    verdict: str
    host: str
    path: str = "/"

    @property
    def name(self) -> str:
        return self.host + self.path

    def fits(self, host: Column, path: Column) -> Column:
        return ((host == self.host) | F.endswith(host, F.lit("." + self.host))) & F.startswith(path, F.lit(self.path))


def host_and_path(url: Column) -> tuple[Column, Column]:
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.char_length(url))).otherwise("")
    host = F.coalesce(F.regexp_extract(rest, r"^[^/?#]*", 0), F.lit(""))
    after = F.coalesce(F.substring(rest, F.char_length(host) + 1, F.char_length(rest)), F.lit(""))
    capitals = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.translate(host, capitals, capitals.lower()), F.regexp_extract(after, r"^[^?#]*", 0)


def apply_rules(pages: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """page_id, url, host, path, and rule and decided (its verdict), null where none fits."""
    host, path = host_and_path(F.col("url"))
    out = pages.withColumn("host", host).withColumn("path", path)
    rule, decided = F.lit(None).cast("string"), F.lit(None).cast("string")
    for r in sorted(rules, key=lambda r: (len(r.name), r.verdict == "block")):
        fits = r.fits(F.col("host"), F.col("path"))
        rule, decided = F.when(fits, r.name).otherwise(rule), F.when(fits, r.verdict).otherwise(decided)
    return out.withColumn("rule", rule).withColumn("decided", decided)


def word_counts(pages: DataFrame) -> DataFrame:
    """word, n: all words of the titles and paths of all pages; host names would bring unsplit names in as words."""
    _, path = host_and_path(F.col("url"))
    title = F.regexp_extract(F.coalesce("html", F.lit("")), r"(?is)<title[^>]*>([^<]*)", 1) if "html" in pages.columns else F.lit("")
    words = F.explode(F.split(F.lower(F.concat_ws(" ", path, title)), r"[^\p{L}]+")).alias("word")
    return settle(pages.select(words).filter(F.char_length("word").between(1, LONGEST)).groupBy("word").agg(F.count(F.lit(1)).alias("n")), "words")


class Segmenter:
    """The likeliest split of a name into words of a unigram lexicon; unknown words cost more the longer they are.

    `counts` may hold only the words found in the names to split; `total` then gives the sum of all counts."""

    def __init__(self, counts: dict[str, int], total: int | None = None):
        total = total or sum(counts.values()) or 1
        self.cost = {w: -log(n / total) for w, n in counts.items()}
        self.unknown = log(total)

    def split(self, name: str) -> tuple[str, ...]:
        best, back = [0.0], [0]
        for end in range(1, len(name) + 1):
            options = []
            for start in range(max(0, end - LONGEST), end):
                word = name[start:end]
                options.append((best[start] + self.cost.get(word, self.unknown + 2.3 * (end - start)), start))
            cost, start = min(options)
            best.append(cost)
            back.append(start)
        out, end = [], len(name)
        while end:
            out.append(name[back[end]:end])
            end = back[end]
        return tuple(reversed(out))

    def tokens(self, host: str) -> list[str]:
        """Words of the host's labels, marked as such; numbers by their length."""
        out = []
        for name in _TOKEN.findall(host):
            out += ["host " + w for w in (self.split(name) if name[0].isalpha() else [f"#{len(name)}"])]
        return out


def path_tokens(path: str) -> list[str]:
    """Pieces of a path; numbers by their length."""
    return [t if not t[0].isdigit() else f"#{len(t)}" for t in _TOKEN.findall(path.lower())]


def _slots(tokens: list[str]) -> list[int]:
    return [zlib.crc32(t.encode()) & (SLOTS - 1) for t in tokens]


def _pieces(host: str) -> Iterator[set[str]]:
    """Everything inside a host's names that may be a word, a bounded number at once."""
    for name in _TOKEN.findall(host):
        if name[0].isalpha():
            for at in range(0, len(name), 4096):
                ends = range(at + 1, min(at + 4096, len(name)) + 1)
                yield {name[start:end] for end in ends for start in range(max(0, end - LONGEST), end)}


def host_slots(hosts: DataFrame, words: DataFrame) -> DataFrame:
    """host and the slots of its tokens, from host and host_id (both unique) and the counts of all words."""
    total = words.agg(F.sum("n")).first()[0] or 0
    parts = int(hosts.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, asked = [], []
        for batch in batches:
            for host_id, host in zip(batch.column("host_id").to_pylist(), batch.column("host").to_pylist()):
                for piece in _pieces(host):
                    ids += [host_id] * len(piece)
                    asked += piece
                    if len(ids) >= 1 << 16:
                        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(asked, pa.string())], ["host_id", "word"])
                        ids, asked = [], []
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(asked, pa.string())], ["host_id", "word"])

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            slots = [_slots(Segmenter({f["word"]: f["n"] for f in found or []}, total).tokens(host))
                     for host, found in zip(batch.column("host").to_pylist(), batch.column("found").to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column("host"), pa.array(slots, pa.list_(pa.int32()))], ["host", "host_slots"])

    # dealt out first: a short word is in many hosts, and what several tasks have written of it can be split in the join
    asked = hosts.repartition(parts, "host_id").mapInArrow(ask, "host_id bigint, word string")
    found = asked.join(words, "word").groupBy("host_id").agg(F.collect_list(F.struct("word", "n")).alias("found"))
    return hosts.join(found, "host_id", "left").select("host", "found").mapInArrow(split, "host string, host_slots array<int>")


def token_counts(decided: DataFrame) -> tuple[dict[str, int], np.ndarray]:
    """(urls per verdict, counts[slot, 0 for allow and 1 for block]) over all decided urls."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros((SLOTS, 2), np.int64)
        for batch in batches:
            for slots, path, verdict in zip(*[batch.column(c).to_pylist() for c in ("host_slots", "path", "decided")]):
                np.add.at(counts, (np.array(slots + _slots(path_tokens(path)), np.int64), int(verdict == "block")), 1)
        used = np.flatnonzero(counts.sum(axis=1))
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(counts[used, 0]), pa.array(counts[used, 1])], ["slot", "allow", "block"])

    classes = {r["decided"]: r["n"] for r in decided.groupBy("decided").agg(F.count(F.lit(1)).alias("n")).collect()}
    rows = (decided.select("host_slots", "path", "decided").mapInArrow(run, "slot bigint, allow bigint, block bigint")
            .groupBy("slot").agg(F.sum("allow").alias("allow"), F.sum("block").alias("block")).collect())  # a row per slot
    counts = np.zeros((SLOTS, 2))
    for r in rows:
        counts[r["slot"]] = r["allow"], r["block"]
    return classes, counts


def judge(pages: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """Per page: page_id, host, path, rule, verdict, and block_log_odds of the model (null where a rule decides)."""
    spark = pages.sparkSession
    ruled = settle(apply_rules(pages.select("page_id", "url"), rules).drop("url"), "urls")
    hosts = settle(ruled.select("host").distinct().withColumn("host_id", F.monotonically_increasing_id()), "hosts")
    split = settle(host_slots(hosts, word_counts(pages)), "host_slots")
    ruled = settle(ruled.join(split, "host"), "url_slots")
    classes, counts = token_counts(ruled.filter("decided IS NOT NULL"))
    n = [classes.get("allow", 0), classes.get("block", 0)]
    prior = log((n[1] + 1) / (n[0] + 1)) if sum(n) else 0.0
    share = np.log((counts + 1) / (counts.sum(axis=0) + SLOTS))
    # slots that no decided url has say nothing about either class
    odds = spark.sparkContext.broadcast((prior, np.where(counts.sum(axis=1) > 0, share[:, 1] - share[:, 0], 0.0).astype(np.float32)))

    def run(batches):
        for batch in batches:
            prior, table = odds.value
            out = []
            for slots, path, decided in zip(*[batch.column(c).to_pylist() for c in ("host_slots", "path", "decided")]):
                out.append(None if decided else prior + float(table[np.array(slots + _slots(path_tokens(path)), np.int64)].sum()))
            verdict = [d or ("block" if o > 0 else "allow") for d, o in zip(batch.column("decided").to_pylist(), out)]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in ("page_id", "host", "path", "rule")], pa.array(verdict, pa.string()),
                                              pa.array(out, pa.float64())], ["page_id", "host", "path", "rule", "verdict", "block_log_odds"])

    kind = pages.schema["page_id"].dataType.simpleString()
    return ruled.select("page_id", "host", "host_slots", "path", "rule", "decided").mapInArrow(
        run, f"page_id {kind}, host string, path string, rule string, verdict string, block_log_odds double")
