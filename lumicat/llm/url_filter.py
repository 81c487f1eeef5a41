"""URL filters: words of host names by unigram Viterbi, then multinomial naive Bayes over host and path words.

1. Word counts of all pages' text, and the seed words, are the unigram model. Spark joins them to the letters that hosts are made
   of, so a task holds the words of one run of letters and no list of words is cut.
2. Hosts are cut at dots, hyphens and digits; what is left is split into words by the most probable segmentation. Paths are
   cut into words likewise. The top-level label is no word.
3. A page whose host holds a seed word is an example of the class to block, every other one of the class to allow; each seed word
   is one more example. Counts per word and class over all pages give the naive Bayes model, which is joined to the words of each
   different host and path.
4. A rule that fits decides; without one the class of the higher posterior does.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumicat.llm.base import stage
from lumicat.llm.tags import without_tags
from lumicat.llm.urls import host_of, path_of

# fixed values: (verdict, host, path), and words that names of unwanted sites are made of
RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))
SEEDS = tuple(
    "ad ads adult adultery affiliate babes bet bets betting bingo cams casino cheap cialis click clicks crack cracked dating escort escorts farm fetish free "
    "gamble gambling hack hentai jackpot keygen loan loans lottery milf nude nudes payday pharmacy pill pills poker porn porno roulette sex sexy slots spam "
    "spammer track tracker tracking viagra warez win winner xxx".split())
#: Seed words that are common in harmless names too: no example by themselves, only beside another seed word.
WEAK = frozenset("ad bet click clicks crack farm free cheap track win winner hack dating loan".split())
SEED_SHARE = 1e-5  # of all words, that a seed word counts for at least
LONGEST = 24
SMOOTH = 1.0
_WORD = re.compile(r"[a-z]+")


class Unigrams(NamedTuple):
    logs: dict[str, float]
    unknown: float  # of a word of one letter; each further letter costs as much as ten times rarer


def word_counts(pages: DataFrame) -> DataFrame:
    """word, n over the whole text of all pages; ASCII letters, folded."""

    def count(batches):
        for batch in batches:
            found = Counter()
            for page in batch.column(0):
                found.update(_WORD.findall(without_tags(page.as_py()).lower()))
            yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.string()), pa.array(list(found.values()), pa.int64())], ["word", "n"])

    return pages.select("html").where("html IS NOT NULL").mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def unigrams(counts: dict[str, int], total: int) -> Unigrams:
    """The model of these words, of ``total`` on all pages, and the seed words."""
    total = max(1, total)
    known = counts | {word: max(counts.get(word, 0), SEED_SHARE * total, 1) for word in SEEDS}
    return Unigrams({w: math.log(n / total) for w, n in known.items()}, -math.log(10 * total))


def segment(letters: str, model: Unigrams) -> list[str]:
    """The most probable words that make up ``letters``; of equal ones that with the longer last word. Long runs take time in
    proportion to their length."""
    best, last = [0.0], [0]
    for end in range(1, len(letters) + 1):
        top, at = -math.inf, end - 1
        for start in range(max(0, end - LONGEST), end):
            p = model.logs.get(letters[start:end])
            p = best[start] + (p if p is not None else model.unknown - math.log(10) * (end - start - 1))
            if p > top:
                top, at = p, start
        best.append(top)
        last.append(at)
    out, end = [], len(letters)
    while end:
        out.append(letters[last[end]: end])
        end = last[end]
    return out[::-1]


def host_words(hosts: DataFrame, counts: DataFrame) -> DataFrame:
    """host, words for each row of ``hosts (host)``, given word counts: each different run of letters meets the counts of its parts."""
    total = counts.agg(F.sum("n")).first()[0] or 0
    # without user, port and top-level label
    body = F.regexp_extract(F.regexp_replace("host", "(?s)^.*@", ""), r"(?s)^([^:]*)\.", 1)
    runs = hosts.select("host", F.posexplode(F.regexp_extract_all(body, F.lit("[a-z]+"), F.lit(0))).alias("at", "run"))

    def parts(batches):
        for batch in batches:
            for run in batch.column(0).to_pylist():
                found = {run[k: k + n] for k in range(len(run)) for n in range(1, min(LONGEST, len(run) - k) + 1)}
                yield pa.RecordBatch.from_arrays([pa.array([run] * len(found), pa.string()), pa.array(list(found), pa.string())], ["run", "word"])

    def cut(batches):
        for batch in batches:
            words = [segment(run, unigrams(dict(known or ()), total)) for run, known in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(maps_as_pydicts="strict"))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(words, pa.list_(pa.string()))], ["run", "words"])

    different = runs.select("run").distinct()
    known = different.mapInArrow(parts, "run string, word string").join(counts, "word").groupBy("run").agg(F.map_from_entries(F.collect_list(F.struct("word", "n"))).alias("known"))
    cuts = different.join(known, "run", "left").select("run", "known").mapInArrow(cut, "run string, words array<string>")
    by_host = runs.join(cuts, "run").groupBy("host").agg(F.flatten(F.expr("transform(sort_array(collect_list(struct(at, words))), x -> x.words)")).alias("words"))
    return hosts.join(by_host, "host", "left").select("host", F.coalesce("words", F.array().cast("array<string>")).alias("words"))


def worded(pages: DataFrame, counts: DataFrame) -> DataFrame:
    """host, path, n, bad, words for each different host and path of pages (url): host words (with ``h:``) and path words (with ``p:``), in
    how many pages, and whether the host is an example of the class to block."""
    urls = stage(pages.groupBy(host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path")).agg(F.count("*").alias("n")))
    seeds = F.filter("words", lambda w: w.isin(*SEEDS))
    example = F.exists(seeds, lambda w: ~w.isin(*sorted(WEAK))) | (F.size(seeds) > 1)
    hosts = stage(host_words(urls.select("host").distinct(), counts).select(
        "host", example.alias("bad"), F.transform("words", lambda w: F.concat(F.lit("h:"), w)).alias("_words")))
    in_path = F.transform(F.regexp_extract_all(F.lower("path"), F.lit("[a-z]+"), F.lit(0)), lambda w: F.concat(F.lit("p:"), w))
    return stage(urls.join(hosts, "host").select("host", "path", "n", "bad", F.concat("_words", in_path).alias("words")))


def train(urls: DataFrame) -> tuple[DataFrame, float]:
    """Naive Bayes from what ``worded`` gives: word, odds (log odds to block) for all words of both classes, and the prior's."""
    seen = urls.select("n", "bad", F.explode("words").alias("word")).groupBy("word").agg(
        F.sum(F.when(F.col("bad"), F.col("n")).otherwise(0)).alias("bad"), F.sum(F.when(F.col("bad"), 0).otherwise(F.col("n"))).alias("good"))
    seeds = urls.sparkSession.range(1).select(F.explode(F.array(*[F.lit("h:" + w) for w in SEEDS if w not in WEAK])).alias("word"), F.lit(1).cast("long").alias("bad"), F.lit(0).cast("long").alias("good"))
    counts = stage(seen)
    bad, good, kinds = (x or 0 for x in counts.agg(F.sum("bad"), F.sum("good"), F.count("*")).first())
    bad_pages, good_pages = (x or 0 for x in urls.agg(F.sum(F.when(F.col("bad"), F.col("n"))), F.sum(F.when(~F.col("bad"), F.col("n")))).first())
    bad += len(SEEDS) - len(WEAK)
    kinds += len(SEEDS) + (bad_pages + good_pages > 0)
    odds = F.log((F.col("bad") + SMOOTH) / (bad + SMOOTH * kinds)) - F.log((F.col("good") + SMOOTH) / (good + SMOOTH * kinds))
    sums = counts.unionByName(seeds).groupBy("word").agg(F.sum("bad").alias("bad"), F.sum("good").alias("good"))
    return sums.select("word", odds.alias("odds")), math.log((bad_pages + 1) / (good_pages + 1))


def rule_for(host: Column, path: Column, rules=RULES) -> Column:
    """The longest rule that fits, as (verdict, rule), or null. A rule fits its host and all subdomains and paths with its beginning."""
    by_length = sorted(rules, key=lambda r: -len(r[1] + r[2]))
    return F.coalesce(*[
        F.when(((host == h) | host.endswith("." + h)) & path.startswith(p), F.struct(F.lit(v).alias("verdict"), F.lit(h + p).alias("rule"))) for v, h, p in by_length
    ], F.lit(None).cast("struct<verdict:string,rule:string>"))


def judge(pages: DataFrame, *, rules=RULES) -> DataFrame:
    """page_id, host, path, rule, verdict, words, score for each row of ``pages (page_id, url, html)``.

    ``score``: probability of the class to block by naive Bayes. Null urls and urls without ``://`` have an empty host and path, no
    words and the prior's score. An empty table gives no rows.
    """
    urls = worded(pages, stage(word_counts(pages)))
    odds, prior = train(urls)
    # sums of decimals do not depend on the order of rows
    sums = urls.select("host", "path", F.explode("words").alias("word")).groupBy("host", "path", "word").agg(F.count("*").alias("k")).join(stage(odds), "word").groupBy("host", "path").agg(
        F.sum((F.col("k") * F.col("odds")).cast("decimal(28,14)")).cast("double").alias("sum"))
    total = F.greatest(F.lit(-35.0), F.least(F.lit(35.0), F.lit(prior) + F.coalesce("sum", F.lit(0.0))))
    by_url = stage(urls.join(sums, ["host", "path"], "left").select(
        "host", "path", F.array_join(F.transform("words", lambda w: F.substring(w, 3, 1 << 30)), " ").alias("words"), (1 / (1 + F.exp(-total))).alias("score")))
    given = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    scored = given.join(by_url, ["host", "path"])
    fit = scored.withColumn("fit", rule_for(F.col("host"), F.col("path"), rules))
    return fit.select(
        "page_id", "host", "path", F.col("fit.rule").alias("rule"),
        F.coalesce(F.col("fit.verdict"), F.when(F.col("score") >= 0.5, "block").otherwise("allow")).alias("verdict"), "words", "score")
