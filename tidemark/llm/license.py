r"""Licence scans by diagonal voting, in SQL functions alone.

Every run of K words of a text is hashed and joined to the places of such runs in the templates. A
match, which holds if the words are equal too, votes for its diagonal, the text position less the template position; diagonals
at most GAP apart are one candidate, so that a few words put in or left out do no harm. A candidate counts
if the template words that its runs cover are enough, within a stretch of the text that is not much longer than
the template. A phrase is a template of which all words have to be there, on one diagonal.
"""

from __future__ import annotations

from string import ascii_lowercase, ascii_uppercase

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as SparkWindow
from pyspark.sql import functions as F

#: Words of a run; how far neighbouring diagonals are apart; the share of a template's words that must be covered.
K, GAP, COVER = 3, 2, 0.8

#: Phrases that count word for word.
PHRASES = {
    "under the mit license": "mit",
    "apache license version 2": "apache-2",
    "cc by nc": "cc-by-nc",
}

#: Sentences and whole texts of public licences, which count if most of one is there.
NOTICES = (
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    ("mit", "released under the mit license"),
    ("apache-2", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license"),
    ("apache-2", "licensed under the apache license version 2 0"),
    ("gpl-3", "this work is licensed under the gnu general public license version 3"),
    ("gpl-3", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("cc-by-nc", "licensed under cc by nc 4 0"),
    ("cc-by-nc", "this work is licensed under a creative commons attribution noncommercial 4 0 international license"),
    (
        "mit",
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction "
        "including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so "
        "subject to the following conditions the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software "
        "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement "
        "in no event shall the authors or copyright holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software "
        "or the use or other dealings in the software",
    ),
    (
        "bsd",
        "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met "
        "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer "
        "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution "
        "this software is provided by the copyright holders and contributors as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed "
        "in no event shall the copyright holder or contributors be liable for any direct indirect incidental special exemplary or consequential damages including but not limited to procurement of substitute goods or services "
        "loss of use data or profits or business interruption however caused and on any theory of liability whether in contract strict liability or tort including negligence or otherwise arising in any way out of the use of this software "
        "even if advised of the possibility of such damage",
    ),
    (
        "apache-2",
        "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache org licenses license 2 0 "
        "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied "
        "see the license for the specific language governing permissions and limitations under the license",
    ),
    (
        "gpl-3",
        "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version "
        "this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose see the gnu general public license for more details "
        "you should have received a copy of the gnu general public license along with this program if not see https www gnu org licenses",
    ),
    (
        "isc",
        "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies "
        "the software is provided as is and the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness "
        "in no event shall the author be liable for any special direct indirect or consequential damages or any damages whatsoever resulting from loss of use data or profits whether in an action of contract negligence or other tortious action "
        "arising out of or in connection with the use or performance of this software",
    ),
)

#: After lower-casing, what parts words: ASCII but for digits and letters.
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def templates() -> list[tuple[int, str, bool, str]]:
    """(number, label, whether it is a phrase, words)."""
    every = [(label, True, words) for words, label in PHRASES.items()] + [(label, False, words) for label, words in NOTICES]
    return [(i, label, phrase, words) for i, (label, phrase, words) in enumerate(every)]


def _runs(spark: SparkSession) -> DataFrame:
    """(hash, words, tid, tpos, label, phrase, length) of every run of a template: a few hundred rows, fixed by the lists above."""
    t = spark.createDataFrame(templates(), "tid int, label string, phrase boolean, words string").withColumn("w", F.split("words", " "))
    return t.select("tid", "label", "phrase", F.size("w").alias("length"), F.posexplode(_grams("w")).alias("tpos", "same")).withColumn("hash", F.xxhash64("same"))


def _grams(words: str):
    """Every K words in a row, a space between."""
    return F.expr(f"if(size({words}) < {K}, cast(array() as array<string>), transform(sequence(0, greatest(0, size({words}) - {K})), i -> concat_ws(' ', {', '.join(f'{words}[i + {j}]' for j in range(K))})))")


def license_scan(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """One row per row of ``docs``: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score.

    n_base counts the places of phrases, first_word and last_word are their smallest and largest start.
    base_labels are those of phrases, labels those of notices too; none give an empty string. score
    is the largest share of a template that was found, 0 for none and 1 for a phrase. Null and empty
    texts have no words. Rows with the same doc_id stay apart. A row goes through one shuffle,
    with its matches only, so of a very long text all runs are hashed where it is read. Other columns are not read. No rows give no rows.
    """
    low = F.regexp_replace(F.translate(F.coalesce(F.col(text), F.lit("")), ascii_uppercase, ascii_lowercase), rf"^{BETWEEN}|{BETWEEN}$", "")
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), low.alias("low")).withColumn("row", F.monotonically_increasing_id())
    rows = rows.select("row", "doc_id", F.expr(f"if(low = '', cast(array() as array<string>), split(low, r'{BETWEEN}'))").alias("w"))
    # place 0 is the row itself, so that one pass serves matches and rows without any
    places = rows.select("row", "doc_id", F.size("w").cast("long").alias("n_words"), F.posexplode(F.concat(F.array(F.lit(None).cast("string")), _grams("w"))).alias("place", "gram")).withColumn("hash", F.when(F.col("gram").isNotNull(), F.xxhash64("gram")))
    found = places.join(F.broadcast(_runs(docs.sparkSession)), "hash", "left").where("place = 0 or gram = same")
    found = found.select("row", "doc_id", "n_words", F.coalesce("tid", F.lit(-1)).alias("tid"), "label", "phrase", "length", "tpos", (F.col("place") - 1).cast("long").alias("pos")).repartition("row")
    lines = found.withColumn("diagonal", F.expr("pos - coalesce(tpos, 0)")).groupBy("row", "tid", "diagonal").agg(F.max("doc_id").alias("doc_id"), F.max("n_words").alias("n_words"), F.max("label").alias("label"), F.max("phrase").alias("phrase"), F.max("length").alias("length"), F.collect_set("tpos").alias("runs"), F.min("pos").alias("lo"), F.max("pos").alias("hi"))
    w = SparkWindow.partitionBy("row", "tid").orderBy("diagonal")
    apart = F.when(F.col("phrase") | (F.col("diagonal") - F.lag("diagonal").over(w) > GAP), 1).otherwise(0)
    joined = lines.withColumn("apart", apart).withColumn("part", F.sum("apart").over(w.rowsBetween(SparkWindow.unboundedPreceding, 0)))
    spans = joined.groupBy("row", "tid", "part").agg(F.max("doc_id").alias("doc_id"), F.max("n_words").alias("n_words"), F.max("label").alias("label"), F.max("phrase").alias("phrase"), F.max("length").alias("length"), F.array_distinct(F.flatten(F.collect_list("runs"))).alias("runs"), F.min("lo").alias("lo"), (F.max("hi") + K).alias("hi"), F.min("diagonal").alias("start"))
    covered = F.size(F.array_distinct(F.flatten(F.transform("runs", lambda t: F.sequence(t, t + K - 1)))))
    spans = spans.withColumn("share", F.when(F.col("tid") >= 0, covered / F.col("length")).otherwise(0.0))
    # a long stretch is a repetition on neighbouring diagonals, each of which has to stand alone
    tight = F.col("hi") - F.col("lo") <= 2 * F.col("length")
    phrase = F.col("phrase") & (F.col("share") == 1.0)
    notice = ~F.col("phrase") & (F.col("share") >= COVER) & tight
    labels = lambda c: F.array_join(F.array_sort(F.collect_set(F.when(c, F.col("label")))), ",")
    out = spans.groupBy("row").agg(
        F.max("doc_id").alias("doc_id"), F.max("n_words").alias("n_words"), F.count_if(phrase).alias("n_base"),
        F.min(F.when(phrase, F.col("start"))).alias("first_word"), F.max(F.when(phrase, F.col("start"))).alias("last_word"),
        labels(phrase).alias("base_labels"), labels(phrase | notice).alias("labels"),
        F.max(F.when(phrase | notice, F.col("share")).otherwise(0.0)).alias("score"),
    )
    return out.drop("row")
