"""Quality rules by distribution divergence, in DataFrame functions alone.

A document's histogram of character classes and that of its language's commonest words are held against those of the
language by Jensen-Shannon distance (square root of the divergence to base 2, 0 to 1). The language's histograms come from all documents
of at least MIN_CHARS characters; the words are the COMMON ones of letters alone that occur most often, and all others are one more
class. A text of which copies are over a 1/HEAVY of all rows is left out of its language's histograms, so that one group of copies does
not shape them; at most HEAVY texts can be such. Guards: a document of fewer than MIN_WORDS words is not compared, nor one whose
language has a histogram of fewer than MIN_REFERENCE words; what a distance may be falls with the document's words as LIMITS say, since
a short text differs from its language by chance.

Beside that stand the base rules: too few words, or too many of them in runs of three words that the text repeats. Words are runs without
white space (space, \\t to \\r). Runs are told apart by a hash that is sorted with its place, equal ones then by their words, so
the work on a text is that of a sort and very long texts are taken whole.

A null text has no words and fails; a null language is a language of its own; repeated rows each get their verdict; input columns other
than the three named are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seqfold.llm.storage import kept

MIN_WORDS = 50
MIN_REFERENCE = 5000  # words
MIN_CHARS = 250  # of a document whose text enters its language's histograms
COMMON = 20
HEAVY = 1000
LIMITS = {"char_distance": (0.15, 1.2), "word_distance": (0.12, 2.0)}  # a + b / sqrt(words); by chance alone a text lies about sqrt(COMMON / (8 ln 2 words)) away
BROADCAST_LANGUAGES = 10_000  # rows of some 2 KB; more of them are joined by a shuffle

SPACE = r"[\x09-\x0D]"  # beside the space itself
#: The character classes that are taken out of a text after small letters and white space, in this order; what is left are other signs.
CLASSES = (r"[^\x00-\x7F]+", r"[A-Z]+", r"[0-9]+", r"[.,;:!?'\"()-]+")
KINDS = len(CLASSES) + 3
SIGNS = r"[#*$%&|<>]+"
NOT_LETTERS = r"[\x00-\x60\x7B-\x7F]"


def _plain(text: Column) -> Column:
    """text with a space for each white space."""
    return F.regexp_replace(text, SPACE, " ")


def _split(plain: Column) -> Column:
    return F.array_remove(F.split(plain, " "), "")


def counted(docs: DataFrame) -> DataFrame:
    """docs (.., plain) with classes, the number of characters of each kind (small letters, white space, CLASSES, others), and n_symbols.

    Runs of small letters and white space go first, so that all other patterns see the small rest."""
    bare = F.replace(F.col("plain"), F.lit(" "), F.lit(""))
    out = docs.withColumns({"_space": F.octet_length("plain") - F.octet_length(bare), "_t": F.regexp_replace("plain", "[a-z ]+", "")})
    kinds, left = [F.length("plain") - F.length("_t") - F.col("_space"), F.col("_space")], "_t"
    for k, pattern in enumerate(CLASSES):
        out = out.withColumn(f"_t{k}", F.regexp_replace(left, pattern, ""))
        kinds.append(F.length(left) - F.length(f"_t{k}"))
        left = f"_t{k}"
    signs = F.length("_t2") - F.length(F.regexp_replace("_t2", SIGNS, ""))
    told = out.withColumns({"classes": F.array(*kinds, F.length(left)).cast("array<long>"), "n_symbols": signs.cast("long")})
    return told.drop("_space", "_t", *[f"_t{k}" for k in range(len(CLASSES))])


def repeated_words(docs: DataFrame) -> DataFrame:
    """docs (.., words) with n_repeat_words, the words inside runs of three that occur at least twice."""
    low = (1 << 31) - 1

    def run(i: Column) -> list[Column]:
        return [F.get("words", i + k) for k in range(3)]

    def tagged(w: Column, i: Column) -> Column:
        return F.shiftleft(F.xxhash64(w, *run(i)[1:]), 31).bitwiseOR(i.cast("long"))

    heads = F.slice("words", 1, F.greatest(F.size("words") - 2, F.lit(0)))
    keyed = docs.withColumn("_s", F.sort_array(F.transform(heads, tagged)))

    follows = F.filter(F.sequence(F.lit(0), F.size("_s")), lambda i: F.shiftright(F.get("_s", i).bitwiseXOR(F.get("_s", i + 1)), 31) == 0)
    alike_tags = F.array_distinct(F.flatten(F.transform(follows, lambda i: F.array(F.get("_s", i), F.get("_s", i + 1)))))
    places = F.transform(alike_tags, lambda x: x.bitwiseAND(low).cast("int"))
    alike = keyed.withColumn("_c", F.sort_array(F.transform(places, lambda i: F.struct(F.concat_ws(" ", *run(i)).alias("run"), i.alias("i")))))

    def same(c: Column, i: Column) -> Column:
        def other(k: Column) -> Column:
            return F.coalesce(F.get("_c", k)["run"] == c["run"], F.lit(False))

        return other(i - 1) | other(i + 1)

    held = F.flatten(F.transform(F.filter("_c", same), lambda c: F.array(c["i"], c["i"] + 1, c["i"] + 2)))
    return alike.withColumn("n_repeat_words", F.size(F.array_distinct(held)).cast("long")).drop("_s", "_c")


def distance(p: Column, q: Column) -> Column:
    """Jensen-Shannon distance of two arrays of shares."""
    def part(a: Column, b: Column) -> Column:
        return F.when(a > 0, a * F.log2(2 * a / (a + b))).otherwise(0.0)

    terms = F.zip_with(p, q, lambda a, b: (part(a, b) + part(b, a)) / 2)
    return F.sqrt(F.greatest(F.aggregate(terms, F.lit(0.0), lambda s, x: s + x), F.lit(0.0)))


def _rest(shares: Column) -> Column:
    return F.concat(shares, F.array(F.lit(1.0) - F.aggregate(shares, F.lit(0.0), lambda s, x: s + x)))


def references(texts: DataFrame) -> DataFrame:
    """(lang, q_classes, common, q_common) of (lang, text): the histograms of each language with enough words."""
    total = texts.count()
    heavy = texts.groupBy(F.xxhash64("text").alias("h")).agg(F.count("*").alias("m")).where(f"m > 1 and m * {HEAVY} > {total}").select("h")  # HEAVY rows at most
    used = texts.where(F.length("text") >= MIN_CHARS).withColumn("h", F.xxhash64("text")).join(F.broadcast(heavy), "h", "left_anti").select("lang", _plain(F.col("text")).alias("plain"))
    sums = counted(used).groupBy("lang").agg(*[F.sum(F.get("classes", F.lit(k))).alias(f"c{k}") for k in range(KINDS)])
    words = used.select("lang", F.explode(_split(F.lower("plain"))).alias("w")).groupBy("lang", "w").agg(F.count("*").alias("m"))
    sizes = words.groupBy("lang").agg(F.sum("m").alias("n")).where(F.col("n") >= MIN_REFERENCE)
    best = words.where(~F.col("w").rlike(NOT_LETTERS)).withColumn("place", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("m"), "w"))).where(F.col("place") <= COMMON)
    listed = best.groupBy("lang").agg(F.sort_array(F.collect_list(F.struct("place", "w", "m"))).alias("best"))
    chars = F.array(*[F.col(f"c{k}") for k in range(KINDS)])
    every = F.aggregate(chars, F.lit(0).cast("long"), lambda s, x: s + x)
    both = sums.join(sizes, "lang").join(listed, "lang", "left").withColumn("best", F.coalesce("best", F.array().cast("array<struct<place:int,w:string,m:bigint>>")))
    return both.select("lang", F.transform(chars, lambda c: c / every).alias("q_classes"), F.col("best.w").alias("common"), F.transform("best", lambda b: b["m"] / F.col("n")).alias("q_common")).withColumn("q_common", _rest(F.col("q_common")))


def judge(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """(doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, char_distance, word_distance) for every row of docs.

    A distance is null where a guard spares the document; such a document is kept if the base rules pass it."""
    texts = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), F.coalesce(F.col(lang_col).cast("string"), F.lit("")).alias("lang"))
    known = kept(references(texts.select("lang", "text")))
    side = F.broadcast(known) if known.count() <= BROADCAST_LANGUAGES else known
    lines = F.filter(F.split("text", "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    told = counted(texts.withColumn("plain", _plain(F.col("text"))).withColumns({"words": _split(F.col("plain")), "lines": lines}))
    told = told.withColumns({"n_words": F.size("words").cast("long"), "n_dup_lines": (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long")})
    held = repeated_words(told).join(side, "lang", "left")
    size, far_enough = F.length("text"), (F.col("n_words") >= MIN_WORDS) & F.col("common").isNotNull()
    asked = F.concat(F.lit("(?<![^ ])(?:"), F.array_join("common", "|"), F.lit(")(?![^ ])"))  # the words are letters alone
    spaced = held.withColumn("_found", F.when(far_enough & (F.size("common") > 0), F.regexp_extract_all(F.lower("plain"), asked, F.lit(0))).when(far_enough, F.array().cast("array<string>")))

    def share(w: Column) -> Column:
        return (F.size("_found") - F.size(F.array_remove("_found", w))) / F.col("n_words")

    compared = spaced.withColumns({
        "char_distance": F.when(far_enough, distance(F.transform("classes", lambda c: c / size), F.col("q_classes"))),
        "_p": F.when(far_enough, F.transform("common", share)),
    })
    far = compared.withColumn("_p", _rest(F.col("_p"))).withColumn("word_distance", F.when(F.col("_p").isNotNull(), distance(F.col("_p"), F.col("q_common"))))
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    fits = F.lit(True)
    for name, (a, b) in LIMITS.items():
        fits = fits & (F.coalesce(name, F.lit(0.0)) <= a + b / F.sqrt("n_words"))
    word_chars = (size - F.get("classes", F.lit(1))).cast("long")
    # kept: a filter on the result would otherwise be pushed below the projections and work out each text's arrays many times over
    return kept(far.select("doc_id", "n_words", word_chars.alias("word_chars"), "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"), (~failed & fits).alias("kept"), "char_distance", "word_distance"))
