"""Substring search through an inverted index of the words' n-grams, kept as bucketed tables.

What is searched are words (or codes) without blanks; a text is found by its words. The index has three tables:

- grams: every distinct word of a kind by each of its n-grams of one to three characters, bucketed by n-gram;
- counts: how many words have an n-gram;
- holders: which rows hold a word, bucketed by word.

A query looks up the counts of its longest n-grams, reads the postings of the rarest one only, checks its few words exactly, and
takes their holders. The texts themselves are never scanned, and no table of the index is shuffled for a query: both joins follow the
buckets. Frequent words cost the index nothing, as n-grams are those of distinct words; they cost a query the rows it returns.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.geo import spread
from ..scratch import settled, shared_folder

#: Longest n-gram of the index.
LONGEST = 3


@dataclass(frozen=True)
class Index:
    grams: DataFrame
    counts: DataFrame
    holders: DataFrame


def ngrams(word: Column, n: Column | int) -> Column:
    """Distinct runs of n characters of a word, an empty array for a shorter one."""
    n = F.lit(n) if isinstance(n, int) else n
    places = F.when(F.length(word) >= n, F.sequence(F.lit(1), F.length(word) - n + 1)).otherwise(F.array().cast("array<int>"))
    return F.array_distinct(F.transform(places, lambda k: F.substr(word, k, n)))


def bucketed(df: DataFrame, name: str, keys: list[str], buckets: int) -> DataFrame:
    """df written into the shared folder in buckets of keys, and read as a table that joins on them without a shuffle."""
    spark = df.sparkSession
    table = f"{name}_{uuid.uuid4().hex}"
    df.repartition(buckets, *keys).write.bucketBy(buckets, *keys).sortBy(*keys).option("path", shared_folder(spark, name)).saveAsTable(table)
    return spark.table(table)


def build(entries: DataFrame, buckets: int = 8) -> Index:
    """entries: kind, word, key; whole is true for words that are only searched as a whole. Null or empty words are left out."""
    entries = entries.where("word IS NOT NULL AND word <> ''")
    holders = bucketed(entries.select("kind", "word", "key", "whole").distinct(), "holders", ["kind", "word"], buckets)
    words = holders.where("NOT whole").select("kind", "word").distinct()
    every = F.flatten(F.array(*(ngrams(F.col("word"), n) for n in range(1, LONGEST + 1))))
    grams = bucketed(words.select("kind", "word", F.explode(every).alias("gram")), "grams", ["kind", "gram"], buckets)
    counts = bucketed(grams.groupBy("kind", "gram").agg(F.count("*").alias("n")), "counts", ["kind", "gram"], buckets)
    return Index(grams, counts, holders)


def find(index: Index, asked: DataFrame) -> DataFrame:
    """kind, piece, whole, key: the rows whose words of that kind hold a piece (are it, if whole). asked: kind, piece, whole."""
    asked = asked.select("kind", "piece", "whole").distinct().where("piece <> ''")
    parts = asked.where("NOT whole").withColumn("gram", F.explode(ngrams(F.col("piece"), F.least(F.lit(LONGEST), F.length("piece")))))
    # a piece with an n-gram that no word has is in no word
    counted = parts.join(index.counts, ["kind", "gram"], "left").groupBy("kind", "piece").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "gram")).alias("rarest"))
    rarest = counted.where("rarest.n > 0").select("kind", "piece", F.col("rarest.gram").alias("gram"))
    words = rarest.join(index.grams, ["kind", "gram"]).where(F.contains("word", "piece")).select("kind", "piece", F.lit(False).alias("whole"), "word")
    words = words.unionByName(asked.where("whole").select("kind", "piece", "whole", F.col("piece").alias("word")))
    held = index.holders.withColumnRenamed("whole", "only_whole")
    return words.join(held, ["kind", "word"]).where("whole OR NOT only_whole").select("kind", "piece", "whole", "key").distinct()


def found_by_all(index: Index, queries: DataFrame) -> DataFrame:
    """query, key: the rows that answer each word of a query. queries: query, word, kind, piece, whole; a word is answered by any of its
    pieces, and a query without words by no row.

    Queries that ask for the same are answered once. Of a query's words the one with the fewest rows is read; the others are looked up
    for those rows only, so a word that nearly all rows have is not paired with its queries.
    """
    words = queries.groupBy("query", "word").agg(F.array_sort(F.collect_set(F.struct("kind", "piece", "whole"))).alias("pieces"))
    asked = settled(words.groupBy("query").agg(F.array_sort(F.collect_set("pieces")).alias("terms")), "asked")
    questions = settled(asked.groupBy("terms").agg(F.min("query").alias("question")), "questions")
    each = questions.select("question", F.explode("terms").alias("pieces"))
    terms = settled(each.select("pieces").distinct().withColumn("term", F.monotonically_increasing_id()), "terms")
    pieces = terms.select("term", F.explode("pieces").alias("p")).select("term", "p.*")
    hits = settled(pieces.join(find(index, pieces), ["kind", "piece", "whole"]).select("term", "key").distinct(), "hits")
    counted = each.join(terms, "pieces").join(hits.groupBy("term").agg(F.count("*").alias("n")), "term", "left")
    rarest = counted.groupBy("question").agg(F.min(F.struct(F.coalesce("n", F.lit(0)), "term"))["term"].alias("term"), F.collect_set("term").alias("others"))
    rarest = rarest.withColumn("others", F.array_except("others", F.array("term")))
    read = rarest.join(hits, "term").drop("term")
    looked_up = read.select("question", "key", F.size("others").alias("n"), F.explode("others").alias("term")).join(hits, ["term", "key"], "left_semi")
    found = looked_up.groupBy("question", "key").agg(F.count("*").alias("hits"), F.first("n").alias("n")).where("hits = n").select("question", "key")
    found = spread(read.where(F.size("others") == 0).select("question", "key").unionByName(found), "key")
    return asked.join(questions, "terms").select("query", "question").join(found, "question").select("query", "key")


def stop_entries(stops: DataFrame) -> DataFrame:
    """What a driver's search looks through. stops: stop, text and district (plain letters a-z, digits and blanks), cep (digits), codes
    (array), numbers (array of the numbers a stop is known by). A number is found as a run of digits of the text or a stop's number; part
    of a word, code or postal code as a substring."""
    text = F.concat_ws(" ", "text", "district")
    runs = F.regexp_extract_all(text, F.lit("[0-9]+"), F.lit(0))
    kinds = {
        "text": (F.split(text, " "), False), "code": (F.transform("codes", F.lower), False), "cep": (F.array("cep"), False),
        "run": (runs, True), "number": (F.transform("numbers", lambda n: n.cast("string")), True),
    }
    rows = [stops.select(F.lit(kind).alias("kind"), F.explode(words).alias("word"), F.col("stop").alias("key"), F.lit(whole).alias("whole")) for kind, (words, whole) in kinds.items()]
    out = rows[0]
    for more in rows[1:]:
        out = out.unionByName(more)
    return out


def stop_queries(queries: DataFrame, code_digits: int = 4, cep_digits: int = 5) -> DataFrame:
    """query, word, kind, piece, whole of what is asked for. queries: query (any key), said (plain letters, digits, # and blanks).

    A number is asked for as a number of the stop, as a run of digits of the text unless # stands before it, from code_digits on as part
    of a code, from cep_digits on as part of the postal code. Another word is part of the text, and of a code if it has a digit.
    """
    words = queries.select("query", F.explode(F.split("said", " ")).alias("word"))
    piece = F.regexp_replace("word", "^#", "")
    words = words.withColumn("piece", piece).where("piece <> ''")
    number, digit = F.col("piece").rlike("^[0-9]+$"), F.col("piece").rlike("[0-9]")
    size, hashed = F.length("piece"), F.startswith("word", F.lit("#"))
    kinds = {
        "text": (~number, False), "code": (F.when(number, size >= code_digits).otherwise(digit), False), "cep": (number & (size >= cep_digits), False),
        "run": (number & ~hashed, True), "number": (number, True),
    }
    asked = F.array_compact(F.array(*(F.when(c, F.struct(F.lit(k).alias("kind"), F.lit(w).alias("whole"))) for k, (c, w) in kinds.items())))
    return words.select("query", "word", "piece", F.explode(asked).alias("a")).select("query", "word", "a.kind", "piece", "a.whole")
