"""Licence scans: sparse TF-IDF cosine to templates, then inheritance from the nearest directory. DataFrame functions only."""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .licence_texts import FORMS
from .shared import forget, saved

LEAST_COSINE = 0.6
#: A line that alone agrees so well stands as it is; the lines around others are joined to them if this share of the line's weight lies in words of the templates.
SURE, SHARE = 0.9, 0.5
#: A header is joined from up to so many lines, of which up to `BEFORE` stand before the line in question, and has about one of these numbers of words.
LINES, BEFORE, WORDS = 48, 24, (12, 20, 32, 48, 72, 112, 168)
#: A word that one of so many texts holds is common.
COMMON = 1000
#: A line without any of these, in lower case or in capitals, declares nothing: every form has one.
MARKS = ("icens", "icenc", "ermission", "edistribut", "unencumbered")
NAMES = r"(?i)^(licen[cs]e|copying|copyright|unlicense)([.-].*)?$"
#: What is taken off a word's ends.
EDGES = ".,;:!?()[]{}<>\"'`*#/\\|%=~-_"


def tokens(text: str) -> list[str]:
    return [w for x in text.lower().split() if (w := x.strip(EDGES))]


VOCABULARY = sorted({w for forms in FORMS.values() for f in forms for w in tokens(f)})


def _spaced(text: Column) -> Column:
    return F.lower(reduce(lambda x, c: F.replace(x, F.lit(c), F.lit(" ")), "\t\n\r\x0b\x0c", text))


def _bare(words: Column) -> Column:
    return F.filter(F.transform(words, lambda w: F.btrim(w, F.lit(EDGES))), lambda w: w != "")


def _tokens(text: Column) -> Column:
    return _bare(F.split(_spaced(text), " "))


def _marked(text: Column) -> Column:
    return reduce(lambda a, b: a | b, [text.contains(m) | text.contains(m.upper()) for m in MARKS])


def lines_of(text: Column) -> Column:
    """A text's lines, and the sentences of a line; without those that have no word."""
    return F.filter(F.split(text, r"\n|(?<=[.!?])[ \t]+"), lambda x: F.btrim(x, F.lit(EDGES + " \t\r\x0b\x0c")) != "")


def frequencies(files: DataFrame, text: Column) -> DataFrame:
    """(w, df): how many of all texts hold each word. Words are counted where they stand before they meet, so a common one makes no large task."""
    distinct = F.array_distinct(_bare(F.array_distinct(F.split(_spaced(text), " "))))
    return files.select(F.explode(distinct).alias("w")).groupBy("w").agg(F.count("*").alias("df"))


class Scorer:
    """Cosines of candidates (rows of `key` columns and words) with the templates, by inverse document frequencies over all texts."""

    def __init__(self, counts: DataFrame, n: int) -> None:
        self.counts, self.n = counts, n
        spark = counts.sparkSession
        df = {r["w"]: r["df"] for r in counts.where(F.col("w").isin(VOCABULARY)).collect()}
        idf = {w: math.log((1 + n) / (1 + df.get(w, 0))) + 1 for w in VOCABULARY}
        rows = []
        for name, forms in FORMS.items():
            for k, form in enumerate(forms):
                tf = Counter(tokens(form))
                norm = math.sqrt(sum((c * idf[w]) ** 2 for w, c in tf.items()))
                rows += [(w, name, k, c * idf[w] * idf[w] / norm) for w, c in sorted(tf.items())]
        # The templates, and words in a thousandth of the texts, are bounded numbers of rows: broadcast, so that no word of many lines is shuffled.
        self.template = F.broadcast(spark.createDataFrame(rows, "w string, license string, form int, weight double"))
        self.known = F.broadcast(spark.createDataFrame([(w, idf[w]) for w in VOCABULARY], "w string, idf double"))

    def vectors(self, terms: DataFrame) -> DataFrame:
        """The terms with x, their weight, and t, that weight if a template has the word."""
        ours = terms.join(self.known, "w").withColumn("ours", F.lit(True))
        others = terms.join(self.known.select("w"), "w", "left_anti")
        often = self.counts.where(F.col("df") * COMMON >= self.n)
        weight = (F.log((1 + self.n) / (1 + F.coalesce("df", F.lit(0)))) + 1).alias("idf")
        common = others.join(F.broadcast(often), "w").select(*others.columns, weight, F.lit(False).alias("ours"))
        others = others.join(F.broadcast(often.select("w")), "w", "left_anti")
        seldom = self.counts.where(F.col("df") * COMMON < self.n).join(others.select("w").distinct(), "w", "left_semi")
        rare = others.join(seldom, "w", "left").select(*others.columns, weight, F.lit(False).alias("ours"))
        return ours.select(*common.columns).unionByName(common).unionByName(rare).withColumn("x", F.col("tf") * F.col("idf"))

    def best(self, terms: DataFrame, key: Sequence[str]) -> DataFrame:
        """key, license, cosine (0 if no word is a template's) of the best form, and share: how much of the candidate's squared weight lies in templates' words."""
        norms = self.vectors(terms).groupBy(*key).agg(F.sum(F.col("x") * F.col("x")).alias("all"), F.sum(F.when(F.col("ours"), F.col("x") * F.col("x")).otherwise(0.0)).alias("in"))
        dots = terms.join(self.template, "w").groupBy(*key, "license", "form").agg(F.sum(F.col("tf") * F.col("weight")).alias("dot"))
        top = dots.groupBy(*key).agg(F.max("dot").alias("dot"), F.min_by("license", F.struct(-F.round("dot", 9), "license")).alias("license"))
        out = norms.join(top, list(key), "left")
        return out.select(*key, "license", F.coalesce(F.round(F.col("dot") / F.sqrt("all"), 9), F.lit(0.0)).alias("cosine"), (F.col("in") / F.col("all")).alias("share"))


def _terms(candidates: DataFrame, key: Sequence[str], text: str) -> DataFrame:
    return candidates.select(*key, F.explode(_tokens(F.col(text))).alias("w")).groupBy(*key, "w").agg(F.count("*").alias("tf"))


def headers(seeds: DataFrame) -> DataFrame:
    """(file, line, from, to, text): the runs of lines of `rows` (file, line, rows) that hold the line, from each start before it and with each of `WORDS` words at least."""
    x = seeds.select("file", "line", "rows", F.explode(F.sequence(F.greatest(F.lit(0), F.col("line") - BEFORE), F.col("line"))).alias("from"))
    part = F.slice("rows", F.col("from") + 1, LINES)
    sizes = F.transform(part, lambda r: F.size(_tokens(r)))
    total = F.transform(F.sequence(F.lit(1), F.size("sizes")), lambda i: F.aggregate(F.slice("sizes", 1, i), F.lit(0), lambda a, b: a + b))
    x = x.select("file", "line", "from", part.alias("part"), sizes.alias("sizes")).withColumn("total", total)
    x = x.select("file", "line", "from", "part", "total", F.explode(F.array(*map(F.lit, WORDS))).alias("words"))
    x = x.withColumn("to", F.least(F.col("from") + F.size(F.filter("total", lambda t: t < F.col("words"))), F.col("from") + F.size("part") - 1))
    x = x.where((F.col("to") >= F.col("line")) & (F.col("to") > F.col("from")))
    return x.dropDuplicates(["file", "line", "from", "to"]).select("file", "line", "from", "to", F.array_join(F.slice("part", F.lit(1), F.col("to") - F.col("from") + 1), " ").alias("text"))


def scan_licenses(files: DataFrame, path_col: str = "path", text_col: str = "text", *, declares: Column | None = None, least: float = LEAST_COSINE, carry: Sequence[str] = ()) -> DataFrame:
    """One row a file: the columns in `carry`, path_col, license, cosine, origin ("own", "inherited" or "none"), from_dir, n_headers.

    Words are runs of characters other than white space, in lower case and without the signs in `EDGES` at their ends, so comment signs and punctuation don't count.
    Each line (or sentence of a line) with one of `MARKS` is compared with all forms. Where it doesn't reach `SURE` alone but `SHARE` of its weight lies in templates' words, it is
    also compared joined with the lines around it, as wrapped headers stand (see `headers`); a file that declares its directory's licence is compared as a whole, too.
    Of a line the greatest cosine counts, and from `least` on it is a licence; of a file its greatest (ties: the first line, then the first name).
    A file that declares one for its directory (by default by its name: LICENSE, COPYING and such; `declares` may say otherwise, over the columns of `files`)
    licenses the directory and what lies below it; a directory with several takes the greatest cosine (ties: the smallest path).
    A file without its own inherits from the nearest directory above it that has one. n_headers counts its lines with a licence.

    Inheritance is settled for each distinct directory and joined to the files by path; directories that hold a thousandth of all files, at most a thousand, are broadcast.
    Repeated rows count as one file to each other; null texts are empty; a null path gets its own licence and inherits nothing. Document frequencies count every row.
    """
    body = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    path = F.col(f"`{path_col}`").cast("string")
    named = F.element_at(F.split(path, "/"), -1).rlike(NAMES) if declares is None else declares
    carried = [F.col(f"`{c}`").alias(f"__l_{i}") for i, c in enumerate(carry)]
    marked = _marked(body)
    slim = files.select(*carried, path.alias("path"), F.coalesce(named, F.lit(False)).alias("declares"), F.when(marked, lines_of(body)).alias("rows"), F.when(marked, F.xxhash64(body)).alias("t"))
    slim = saved(slim.withColumn("file", F.struct(F.coalesce("path", F.lit("")).alias("p"), F.col("path").isNull().alias("z"), "t")), "files")
    texts = slim.where("t IS NOT NULL").select("file", "rows", "declares")
    single = texts.dropDuplicates(["file"])
    lines = texts.select("file", F.posexplode("rows").alias("line", "text")).where(_marked(F.col("text"))).dropDuplicates(["file", "line"])
    whole = single.where("declares").select("file", F.lit(-1).alias("line"), F.array_join("rows", " ").alias("text"))
    alone = saved(_terms(lines.unionByName(whole), ["file", "line"], "text"), "line-terms")
    score = Scorer(saved(frequencies(files, body), "words"), slim.count())
    first = saved(score.best(alone, ["file", "line"]), "line-scores")
    seeds = first.where((F.col("line") >= 0) & (F.col("cosine") < SURE) & (F.col("share") >= SHARE)).select("file", "line")
    key = ["file", "line", "from", "to"]
    joined = saved(_terms(headers(seeds.join(single.select("file", "rows"), "file")), key, "text"), "header-terms")
    found = first.select("file", "line", "license", "cosine").unionByName(score.best(joined, key).select("file", "line", "license", "cosine")).where(F.col("cosine") >= least)
    found = saved(found.groupBy("file", "line").agg(F.max("cosine").alias("cosine"), F.min_by("license", F.struct(-F.col("cosine"), "license")).alias("license")), "licences")
    for table in (alone, score.counts, first, joined):
        forget(table)
    own = found.groupBy("file").agg(F.max("cosine").alias("cosine"), F.min_by("license", F.struct(-F.col("cosine"), "line", "license")).alias("license"), F.count_if(F.col("line") >= 0).alias("n_headers"))
    return _inherited(slim, own, path_col, carry)


def _inherited(slim: DataFrame, own: DataFrame, path_col: str, carry: Sequence[str]) -> DataFrame:
    key = F.struct("file.p", "file.z", F.coalesce("file.t", F.lit(0).cast("long")).alias("t"))
    keyed = own.select(key.alias("f"), "cosine", "license", "n_headers")
    columns = [f"__l_{i}" for i in range(len(carry))]
    dir_of = F.when(F.col("path").contains("/"), F.regexp_replace("path", r"/[^/]*$", "")).when(F.col("path").isNotNull(), F.lit(""))
    known = slim.select(*columns, "path", "declares", F.col("t").isNotNull().alias("has"), key.alias("f"), dir_of.alias("dir"))
    known = saved(known.where("has").join(keyed, "f", "left").unionByName(known.where("NOT has"), allowMissingColumns=True).drop("f", "has"), "known")
    given = known.where(F.col("declares") & F.col("license").isNotNull() & F.col("dir").isNotNull()).groupBy("dir").agg(F.min_by("license", F.struct(-F.col("cosine"), "path", "license")).alias("dir_license")).select(F.col("dir").alias("up"), "dir_license")
    dirs = known.where("dir IS NOT NULL").groupBy("dir").agg(F.count("*").alias("n"))
    parts = F.split("dir", "/")
    above = dirs.select("dir", "n", F.explode(F.when(F.col("dir") == "", F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), F.size(parts)))).alias("depth")).select("dir", "n", "depth", F.array_join(F.slice(parts, F.lit(1), F.col("depth")), "/").alias("up"))
    nearest = saved(above.join(given, "up").groupBy("dir", "n").agg(F.max_by(F.struct("dir_license", "up"), "depth").alias("b")).select("dir", "n", "b.*"), "nearest")
    total = known.count()
    hot = F.col("n") * COMMON >= F.lit(total)
    few, rest = F.broadcast(nearest.where(hot).drop("n")), nearest.where(~hot).drop("n")
    by_few = known.join(few, "dir").unionByName(known.join(few.select("dir"), "dir", "left_anti").join(rest, "dir", "left"))
    origin = F.when(F.col("license").isNotNull(), "own").when(F.col("dir_license").isNotNull(), "inherited").otherwise("none")
    return by_few.select(*(F.col(c).alias(name) for c, name in zip(columns, carry, strict=True)), F.col("path").alias(path_col), F.coalesce("license", "dir_license").alias("license"), "cosine", origin.alias("origin"), F.when(F.col("license").isNull(), F.col("up")).alias("from_dir"), F.coalesce("n_headers", F.lit(0)).cast("long").alias("n_headers"))


def op7_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as files source/lang/doc_id.txt; one of under 20 words with a licence declares it for its directory. A document without an id has no path."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    path = F.when(F.col("doc_id").isNotNull(), F.concat_ws("/", F.coalesce("source", F.lit("unknown")), F.coalesce("lang", F.lit("unknown")), F.concat(F.col("doc_id").cast("string"), F.lit(".txt"))))
    short = F.size(F.split(F.coalesce("text", F.lit("")), r"\s+", 20)) < 20
    return scan_licenses(docs.select("doc_id", path.alias("path"), "text"), declares=short, carry=["doc_id"])
