"""Licence scans by diagonal voting, in DataFrame functions only.

Every rolling group of ``K`` words of a text is joined, over its hash, with the places of the same
words in the templates (a broadcast: the templates are a list in the code). A match votes for a
diagonal: text position less template position, that is, where the template would start. Votes are
gathered by diagonal; neighbouring diagonals, which a word put in or left out sets apart, are merged
into spans. A span is verified on both sides: words of the template that it lacks and words of the text
in it that no vote explains both lower its score, and the words that tell the licence from its
neighbours (the template's core) must stand in it in one piece. Of spans inside each other the
longer one counts, so that of neighbouring licences the best cover wins.
"""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarrymill.session import table

K = 3
#: Diagonals at most so far apart are one span, and a span counts from this share of the template on.
NEAR, LEAST_COVER = 3, 0.8
#: Phrases that count wherever they stand, word for word, and their labels.
BASE = [
    ("mit", "under the mit license"),
    ("apache-2", "apache license version 2"),
    ("cc-by-nc", "cc by nc"),
]
#: Further public notices, which may be found with small changes.
NOTICES = [
    ("all-rights-reserved", "all rights reserved"),
    ("apache-2", "licensed under the apache license version 2 0"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted"),
    ("cc-by-nc", "licensed under cc by nc 4 0"),
    ("gpl-3", "licensed under the gnu general public license version 3"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software"),
    ("mit", "released under the mit license"),
]
#: The core of each of ``NOTICES``, in their order (fixed values).
CORES = [
    "all rights reserved",
    "apache license version 2",
    "redistribution and use in source and binary forms",
    "cc by nc 4 0",
    "gnu general public license version 3",
    "a copy of this software",
    "the mit license",
]
#: Labels, notices and cores of neighbouring licences.
NEIGHBOURS = [
    ("agpl-3", "licensed under the gnu affero general public license version 3", "gnu affero general public license version 3"),
    ("apache-1.1", "licensed under the apache software license version 1 1", "apache software license version 1 1"),
    ("boost-1", "distributed under the boost software license version 1 0", "boost software license version 1 0"),
    ("boost-1", "permission is hereby granted free of charge to any person or organization obtaining a copy of the software", "any person or organization obtaining a copy"),
    ("cc-by", "licensed under cc by 4 0", "cc by 4 0"),
    ("cc-by-nc-nd", "licensed under cc by nc nd 4 0", "cc by nc nd 4 0"),
    ("cc-by-nc-sa", "licensed under cc by nc sa 4 0", "cc by nc sa 4 0"),
    ("cc-by-nd", "licensed under cc by nd 4 0", "cc by nd 4 0"),
    ("cc-by-sa", "licensed under cc by sa 4 0", "cc by sa 4 0"),
    ("epl-1", "made available under the terms of the eclipse public license v1 0", "eclipse public license v1 0"),
    ("epl-2", "made available under the terms of the eclipse public license 2 0", "eclipse public license 2 0"),
    ("gpl-2", "licensed under the gnu general public license version 2", "gnu general public license version 2"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", "with or without fee is hereby granted"),
    ("lgpl-2", "licensed under the gnu lesser general public license version 2", "gnu lesser general public license version 2"),
    ("lgpl-2", "licensed under the gnu library general public license version 2", "gnu library general public license version 2"),
    ("lgpl-2.1", "licensed under the gnu lesser general public license version 2 1", "gnu lesser general public license version 2 1"),
    ("lgpl-3", "licensed under the gnu lesser general public license version 3", "gnu lesser general public license version 3"),
    ("mpl-1.1", "subject to the mozilla public license version 1 1", "mozilla public license version 1 1"),
    ("mpl-2", "subject to the terms of the mozilla public license v 2 0", "mozilla public license v 2 0"),
    ("unlicense", "this is free and unencumbered software released into the public domain", "software released into the public domain"),
]
#: Labels, wording and cores of whole public licence texts.
WHOLE = [
    (
        "isc",
        "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the "
        "above copyright notice and this permission notice appear in all copies the software is provided as is and the author disclaims all "
        "warranties with regard to this software including all implied warranties of merchantability and fitness in no event shall the author "
        "be liable for any special direct indirect or consequential damages or any damages whatsoever resulting from loss of use data or "
        "profits whether in an action of contract negligence or other tortious action arising out of or in connection with the use or "
        "performance of this software",
        "with or without fee is hereby granted",
    ),
    (
        "mit",
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the "
        "software to deal in the software without restriction including without limitation the rights to use copy modify merge publish "
        "distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to "
        "the following conditions the above copyright notice and this permission notice shall be included in all copies or substantial "
        "portions of the software the software is provided as is without warranty of any kind express or implied including but not limited to "
        "the warranties of merchantability fitness for a particular purpose and noninfringement in no event shall the authors or copyright "
        "holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or "
        "in connection with the software or the use or other dealings in the software",
        "to any person obtaining a copy of this software",
    ),
    (
        "zlib",
        "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages "
        "arising from the use of this software permission is granted to anyone to use this software for any purpose including commercial "
        "applications and to alter it and redistribute it freely subject to the following restrictions 1 the origin of this software must not "
        "be misrepresented you must not claim that you wrote the original software if you use this software in a product an acknowledgment in "
        "the product documentation would be appreciated but is not required 2 altered source versions must be plainly marked as such and must "
        "not be misrepresented as being the original software 3 this notice may not be removed or altered from any source distribution",
        "permission is granted to anyone to use this software for any purpose",
    ),
]
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: The one character beyond ASCII whose lower case is an ASCII letter, and a word character that
#: stands in for it, since it is not to match that letter (fixed values: Unicode).
KELVIN, NOT_K = "\u212a", "\u0138"


def words(text: Column) -> Column:
    """The words of a text, lower-cased."""
    cut = F.split(F.lower(F.replace(text, F.lit(KELVIN), F.lit(NOT_K))), BETWEEN)
    before, after = (F.element_at(cut, 1) == "").cast("int"), (F.element_at(cut, -1) == "").cast("int")
    return F.slice(cut, before + 1, F.greatest(F.size(cut) - before - after, F.lit(0)))


def gram_rows(df: DataFrame, *keys: str) -> DataFrame:
    """``df`` (``words`` and ``keys``) with a row for each group of ``K`` words: ``place, w0.., gram``."""
    several = F.arrays_zip(*[F.slice("words", k + 1, F.greatest(F.size("words") - (K - 1), F.lit(0))).alias(f"w{k}") for k in range(K)])
    cut = df.select(*keys, F.posexplode(several).alias("place", "g")).select(*keys, "place", "g.*")
    return cut.withColumn("gram", F.xxhash64(*[F.col(f"w{k}") for k in range(K)]))


def core_place(phrase: str, core: str) -> tuple[int, int]:
    """The first and last word group of ``phrase`` that lie in ``core``."""
    whole, part = phrase.split(), core.split()
    first = next(i for i in range(len(whole)) if whole[i : i + len(part)] == part)
    return first, first + len(part) - K


#: Label, whether a base phrase (all of it core), wording, and first and last group of the core.
TEMPLATES = [
    (label, base, phrase, *core_place(phrase, core))
    for label, base, phrase, core in [
        *[(label, True, phrase, phrase) for label, phrase in BASE],
        *[(label, False, phrase, core) for (label, phrase), core in zip(NOTICES, CORES, strict=True)],
        *[(label, False, phrase, core) for label, phrase, core in NEIGHBOURS + WHOLE],
    ]
]
#: Places of a template are bits of so many longs.
LONGS = -(-max(len(phrase.split()) for _, _, phrase, _, _ in TEMPLATES) // 64)
MASKS = [f"mask{j}" for j in range(LONGS)]


def templates(spark: SparkSession) -> DataFrame:
    """Each template's word groups: ``template, label, base, size, core_first, core_last, at, t0.. , gram``."""
    names = ("label", "base", "phrase", "core_first", "core_last")
    rows = [F.struct(F.lit(i).alias("template"), *[F.lit(v).alias(n) for n, v in zip(names, t, strict=True)]) for i, t in enumerate(TEMPLATES)]
    listed = spark.range(1).select(F.explode(F.array(*rows)).alias("t")).select("t.*", words(F.col("t.phrase")).alias("words"))
    cut = gram_rows(listed.withColumn("size", F.size("words")), "template", "label", "base", "size", "core_first", "core_last")
    return cut.withColumnsRenamed({"place": "at", **{f"w{k}": f"t{k}" for k in range(K)}})


def mask_of(place: str) -> list[Column]:
    """The bits of the places in a column, gathered by a group, as ``MASKS``."""
    return [F.expr(f"bit_or(if({place} div 64 = {j}, shiftleft(1L, cast({place} % 64 as int)), 0L))").alias(m) for j, m in enumerate(MASKS)]


def has(place: Column) -> Column:
    """Whether ``MASKS`` have the bit of a place; there are none below 0."""
    bit = F.getbit(F.get(F.array(*MASKS), F.floor(place / 64).cast("int")), F.pmod(place, F.lit(64)))
    return F.coalesce(bit == 1, F.lit(False))


def diagonals(docs: DataFrame, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """Votes by diagonal: ``doc_id, text_hash, template, label, base, size, core_first, core_last,
    start`` and ``MASKS``, which have a bit for each word group of the template that was found."""
    body = F.coalesce(F.col(text), F.lit(""))
    cut = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(body).alias("text_hash"), words(body).alias("words"))
    found = gram_rows(cut, "doc_id", "text_hash").join(F.broadcast(templates(docs.sparkSession)), "gram")
    for k in range(K):  # the hash alone does not decide
        found = found.filter(F.col(f"w{k}") == F.col(f"t{k}"))
    keys = ["doc_id", "text_hash", "template", "label", "base", "size", "core_first", "core_last"]
    return found.groupBy(*keys, (F.col("place") - F.col("at")).alias("start")).agg(*mask_of("at"))


def spans(votes: DataFrame) -> DataFrame:
    """Merged diagonals: ``doc_id, text_hash, template, label, first, last, low, high, cover, score,
    cored, n_base, first_base, last_base``.

    ``low`` and ``high`` are the first and last word of the text in the span, ``cover`` is the share
    of the template's words that it has, and ``score`` the same over the template's words and the
    span's words that no vote explains.
    """
    keys = ["doc_id", "text_hash", "template", "label", "base", "size"]
    along = Window.partitionBy("doc_id", "text_hash", "template").orderBy("start")
    apart = F.coalesce(F.col("start") - F.lag("start").over(along) > NEAR, F.lit(True))
    numbered = votes.withColumn("apart", apart.cast("int")).withColumn("span", F.sum("apart").over(along))
    cored = F.forall(F.sequence("core_first", "core_last"), has)
    in_group = lambda i: reduce(or_, [has(i - k) for k in range(K)])  # noqa: E731  a word of a group that was found
    places = F.filter(F.sequence(F.lit(0), F.col("size").cast("int") - 1), in_group)
    by_word = numbered.withColumn("cored", cored).select(*keys, "span", "start", "cored", F.posexplode(places).alias("nth", "at"))
    whole = F.col("base") & F.col("cored")
    by_word = by_word.groupBy(*keys, "span", (F.col("start") + F.col("at")).alias("word")).agg(
        *mask_of("at"),
        F.min("start").alias("first"),
        F.max("start").alias("last"),
        F.bool_or("cored").alias("cored"),
        F.count_if(whole & (F.col("nth") == 0)).alias("n_base"),
        F.min(F.when(whole, F.col("start"))).alias("first_base"),
        F.max(F.when(whole, F.col("start"))).alias("last_base"),
    )
    merged = by_word.groupBy(*keys, "span").agg(
        *[F.bit_or(m).alias(m) for m in MASKS],
        F.min("first").alias("first"),
        F.max("last").alias("last"),
        F.min("word").alias("low"),
        F.max("word").alias("high"),
        F.count(F.lit(1)).alias("explained"),
        F.bool_or("cored").alias("cored"),
        F.sum("n_base").alias("n_base"),
        F.min("first_base").alias("first_base"),
        F.max("last_base").alias("last_base"),
    )
    found = sum((F.bit_count(m) for m in MASKS), F.lit(0))
    strange = F.col("high") - F.col("low") + 1 - F.col("explained")
    return merged.withColumns({"cover": found / F.col("size"), "score": found / (F.col("size") + strange)})


def counted(found: DataFrame) -> DataFrame:
    """The spans with ``counts``: they have a core and ``LEAST_COVER`` as score, and lie in no longer
    span of which that is true; of spans of the same words the best score counts."""
    good = F.col("cored") & (F.col("score") >= LEAST_COVER)
    of_text = ["doc_id", "text_hash"]
    high, score = F.when(good, F.col("high")), F.when(good, F.col("score"))
    earlier = Window.partitionBy(*of_text).orderBy("low").rangeBetween(Window.unboundedPreceding, -1)
    beaten = (
        (F.max(high).over(earlier) >= F.col("high")),
        (F.max(high).over(Window.partitionBy(*of_text, "low")) > F.col("high")),
        (F.max(score).over(Window.partitionBy(*of_text, "low", "high")) > F.col("score")),
    )
    marked = found.withColumns({f"_beaten{i}": F.coalesce(b, F.lit(False)) for i, b in enumerate(beaten)})
    return marked.withColumn("counts", good & ~F.col("_beaten0") & ~F.col("_beaten1") & ~F.col("_beaten2"))


def license_scan(docs: DataFrame, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """``doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score`` for each row.

    Words are runs of ASCII letters and digits and of all characters beyond ASCII, A-Z lowered.
    ``base_labels`` are those of base phrases, ``labels`` also those of spans that count. ``score``
    is the largest share of a template that a span of the text with the template's core covers, where
    words of the span that the template lacks count like missing ones; without such a span it is 0.
    Very long texts are scanned whole. A null or empty text has no words, no labels and score 0. Rows that repeat an id are each scanned by
    their own text; rows that repeat as a whole get equal results. An empty table gives an empty
    result; other columns are not read.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(body).alias("text_hash"), F.size(words(body)).cast("bigint").alias("n_words"))
    is_base, counts = F.col("n_base") > 0, (F.col("n_base") > 0) | F.col("counts")
    joined = lambda keep: F.array_join(F.array_sort(F.collect_set(F.when(keep, F.col("label")))), ",")  # noqa: E731  bounded by the labels
    by_doc = (
        counted(spans(diagonals(docs, text, id_col)))
        .groupBy(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash"))
        .agg(
            F.sum("n_base").alias("n_base"),
            F.min("first_base").cast("bigint").alias("first_word"),
            F.max("last_base").cast("bigint").alias("last_word"),
            joined(is_base).alias("base_labels"),
            joined(counts).alias("labels"),
            F.max(F.when(F.col("cored"), F.col("score"))).alias("score"),
        )
    )
    same = F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("text_hash") == F.col("_hash"))
    return rows.join(by_doc, same, "left").select(
        "doc_id",
        "n_words",
        F.coalesce("n_base", F.lit(0)).cast("bigint").alias("n_base"),
        "first_word",
        "last_word",
        F.coalesce("base_labels", F.lit("")).alias("base_labels"),
        F.coalesce("labels", F.lit("")).alias("labels"),
        F.coalesce("score", F.lit(0.0)).alias("score"),
    )


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan(table(spark, sf_dir, "documents"))


_LISTED = ", ".join(f"({i}, '{label}', {base}, '{phrase}', {low}, {high})" for i, (label, base, phrase, low, high) in enumerate(TEMPLATES))
ORACLE = f"""
WITH t(template, label, base, phrase, core_first, core_last) AS (VALUES {_LISTED}),
tw AS (SELECT *, string_split(phrase, ' ') AS w FROM t),
tg AS (
    SELECT template, label, base, len(w) AS size, core_first, core_last, i AS pos, w[i + 1] AS a, w[i + 2] AS b, w[i + 3] AS c
    FROM (SELECT *, unnest(range(len(w) - 2)) AS i FROM tw)
),
d AS (
    SELECT doc_id,
           regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w
    FROM documents
),
u AS (SELECT doc_id, unnest(w) AS a, generate_subscripts(w, 1) - 1 AS i FROM d),
g AS (
    SELECT doc_id, i, a, lead(a, 1) OVER o AS b, lead(a, 2) OVER o AS c FROM u WINDOW o AS (PARTITION BY doc_id ORDER BY i)
),
v AS (
    SELECT doc_id, template, label, base, size, i - pos AS start, list(pos) AS places,
           count(*) FILTER (pos BETWEEN core_first AND core_last) = core_last - core_first + 1 AS cored
    FROM g JOIN tg USING (a, b, c) GROUP BY doc_id, template, label, base, size, core_first, core_last, start
),
n AS (
    SELECT *, sum(apart) OVER (PARTITION BY doc_id, template ORDER BY start) AS span
    FROM (
        SELECT *, CASE WHEN start - lag(start) OVER (PARTITION BY doc_id, template ORDER BY start) <= {NEAR} THEN 0 ELSE 1 END AS apart
        FROM v
    )
),
pw AS (
    SELECT doc_id, template, span, count(DISTINCT pos + k) AS found, count(DISTINCT start + pos + k) AS explained,
           min(start + pos + k) AS low, max(start + pos + k) AS high
    FROM (SELECT doc_id, template, span, start, unnest(places) AS pos FROM n), range({K}) AS r(k)
    GROUP BY doc_id, template, span
),
s AS (
    SELECT doc_id, template, label, span, low, high, cored, n_base, first_base, last_base, found / (size + high - low + 1 - explained) AS score
    FROM (
        SELECT doc_id, template, label, size, span, bool_or(cored) AS cored,
               count(*) FILTER (base AND cored) AS n_base,
               min(start) FILTER (base AND cored) AS first_base,
               max(start) FILTER (base AND cored) AS last_base
        FROM n GROUP BY doc_id, template, label, size, span
    ) JOIN pw USING (doc_id, template, span)
),
good AS (SELECT * FROM s WHERE cored AND score >= {LEAST_COVER}),
beaten AS (
    SELECT DISTINCT x.doc_id, x.template, x.span
    FROM good AS x JOIN good AS y USING (doc_id)
    WHERE y.low < x.low AND y.high >= x.high OR y.low = x.low AND y.high > x.high OR y.low = x.low AND y.high = x.high AND y.score > x.score
),
counting AS (SELECT doc_id, template, span, true AS counts FROM good ANTI JOIN beaten USING (doc_id, template, span)),
r AS (
    SELECT doc_id, sum(n_base)::BIGINT AS n_base, min(first_base) AS first_word, max(last_base) AS last_word,
           string_agg(DISTINCT label, ',' ORDER BY label) FILTER (n_base > 0) AS base_labels,
           string_agg(DISTINCT label, ',' ORDER BY label) FILTER (n_base > 0 OR counts) AS labels,
           max(score) FILTER (cored) AS score
    FROM s LEFT JOIN counting USING (doc_id, template, span) GROUP BY doc_id
)
SELECT d.doc_id, len(d.w) AS n_words, coalesce(n_base, 0) AS n_base, first_word::BIGINT AS first_word, last_word::BIGINT AS last_word,
       coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, coalesce(score, 0.0) AS score
FROM d LEFT JOIN r USING (doc_id)
"""
