"""References to files in the text of other files that no code scanner reads."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import code, text
from ..tables import cut

#: Characters of the keys of names without a word.
GRAM = 3
#: Distinct keys sent to every executor, at most; with more of them texts and keys meet in a shuffle.
SENT = 1_000_000


def mentioned(files: DataFrame, parts: DataFrame) -> DataFrame:
    """(src, part): src's text holds a part with no letter, digit or underscore next to it.

    Texts and parts meet on words, by hash joins: a mention holds each run of word characters of the part as a whole run.
    First the texts keep those of their words that any part has, which also tells how many texts have each.  Then a part
    meets only the texts that have its rarest word, so words that most parts or texts share make no pairs.  A part without
    any word has its first GRAM characters as key (all, if it is shorter) and meets the texts' runs of so many other
    characters, which are looked for only if there is such a part.  Where the part is one word the meeting is the mention;
    only the other pairs are verified by a pattern.
    """
    word, other = r"[\p{L}\p{N}_]+", r"[^\p{L}\p{N}_]"
    runs = F.array_distinct(F.regexp_extract_all("part", F.lit(word), F.lit(0)))
    split = parts.where("part <> ''").distinct().select("part", runs.alias("runs")).select("part", F.when(F.size("runs") > 0, F.col("runs")).otherwise(F.array(F.substring("part", 1, GRAM))).alias("keys"))
    keys = cut(split.select(F.explode("keys").alias("key")).distinct(), "keys")
    n, wordless = keys.agg(F.count("*"), F.count_if(~F.col("key").rlike(word))).collect()[0]
    texts = files.where(~text.extension(F.col("file")).isin(list(code.LANGUAGES)) & F.col("content").isNotNull()).select(F.col("file").alias("src"), "content")
    tokens = texts.select("src", F.explode(F.array_distinct(F.regexp_extract_all("content", F.lit(word), F.lit(0)))).alias("key"))
    if wordless:
        grams = F.concat(*(F.regexp_extract_all("content", F.lit(f"(?=({other}{{{k}}}))"), F.lit(1)) for k in range(1, GRAM + 1)))
        tokens = tokens.union(texts.select("src", F.explode(F.array_distinct(grams))))
    tokens = cut(tokens.join(F.broadcast(keys) if n <= SENT else keys, "key", "left_semi"), "tokens")
    # a part with a word that no text has is nowhere mentioned
    shared = split.select("part", F.size("keys").alias("n"), F.explode("keys").alias("key")).join(tokens.groupBy("key").agg(F.count("*").alias("k")), "key")
    rarest = shared.groupBy("part", "n").agg(F.count("*").alias("known"), F.min_by("key", F.struct("k", "key")).alias("key")).where("known = n")
    keyed = rarest.select("part", "key", ((F.col("key") == F.col("part")) & F.col("part").rlike(f"^{word}$")).alias("sure"))
    met = cut(tokens.join(keyed, "key").select("src", "part", "sure"), "met")
    verified = F.contains("content", F.col("part")) & text.mentions(F.col("content"), F.col("part"))
    checked = met.where("not sure").join(texts, "src").where(verified)
    return met.where("sure").select("src", "part").union(checked.select("src", "part"))


def references(files: DataFrame, names: DataFrame | None = None) -> DataFrame:
    """(src, dst): src's text names dst by its path or its file name, with no letter, digit or underscore next to it.

    A path ends in its file name behind a slash, so who names the path names the file name, and texts are matched with
    distinct file names once, however many files share one.  A name that ends in a slash has an empty file name, which
    nothing mentions: it is found as a whole only.  An empty name is mentioned nowhere.
    """
    names = (names or files).select(F.col("file").alias("dst")).where("dst <> ''").distinct()
    base = text.basename(F.col("dst"))
    named = names.select("dst", F.when(base == "", F.col("dst")).otherwise(base).alias("part"))
    found = mentioned(files, named.select("part").distinct())
    return found.join(named, "part").where("src <> dst").select("src", "dst").distinct()


def with_references(features: DataFrame, found: DataFrame) -> DataFrame:
    """features with the references, in the order of names, after the dependencies."""
    lists = found.groupBy(F.col("src").alias("file")).agg(F.array_sort(F.collect_list("dst")).alias("_refs"))
    joined = features.join(lists, "file", "left")
    return joined.withColumn("dependencies", F.concat("dependencies", F.coalesce("_refs", F.array().cast("array<string>")))).drop("_refs")
