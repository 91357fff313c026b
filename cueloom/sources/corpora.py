"""Scripts, tokens and cues made from the driver's tables, with times by integer rules so that any engine gets the same."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cueloom.functions.text import clean_display, visible_len
from cueloom.sources.tables import table

#: Milliseconds by residue of the cue's place: short and long durations, gaps and overlaps all occur.
DURATIONS = (700, 1900, 3100, 6500, 13000)
GAPS = (80, -150, 80, 900, 200, 1700, 80)


#: What the letters a to z stand for in made scripts of languages that the tables don't have: fixed values, which hold every class of the rules.
DENSE_LETTERS = {
    "zh": "的地得把被他她一声了着过人山水走路看“”‘’：，。！",
    "ko": "가나다라마바사아자차카타파하고노도로“”‘’?!,.",
    "ja": "はがをにでともの駅前友年月アイウっー一二三円人、。「",
}
#: Documents in these languages become scripts in those.
DENSE_LANGUAGES = {"de": "zh", "es": "ko", "fr": "ja"}
LETTERS = "abcdefghijklmnopqrstuvwxyz"


def dense(text: Column, language: str) -> Column:
    """``text`` with its letters, of either case, as characters of a dense script."""
    return F.translate(text, LETTERS + LETTERS.upper(), DENSE_LETTERS[language] * 2)


def dense_scripts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """script_id, language, profile, display_text of the other documents, as Chinese, Korean and Japanese scripts."""
    lang = F.col("lang")
    language = F.create_map(*[F.lit(x) for pair in DENSE_LANGUAGES.items() for x in pair])[lang]
    docs = table(spark, sf_dir, "documents").where(lang.isin(*DENSE_LANGUAGES)).withColumn("shown", clean_display(F.col("text"), compose=False))
    text = F.coalesce(*[F.when(lang == own, dense(F.col("shown"), to)) for own, to in DENSE_LANGUAGES.items()])
    return docs.select(F.col("doc_id").alias("script_id"), language.alias("language"), F.lit("standard").alias("profile"), text.alias("display_text")).where("display_text IS NOT NULL")


def dense_cues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The conversations' cues with Chinese (even script_id) and Korean text."""
    chinese = F.pmod("script_id", F.lit(2)) == 0
    cues = conversation_cues(spark, sf_dir)
    return cues.withColumn("text", F.when(chinese, dense(F.col("text"), "zh")).otherwise(dense(F.col("text"), "ko"))).withColumn("language", F.when(chinese, "zh").otherwise("ko"))


def english_scripts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """script_id, language, profile, display_text of the English documents. Their text is composed already."""
    docs = table(spark, sf_dir, "documents").where("lang = 'en'")
    return docs.select(F.col("doc_id").alias("script_id"), F.col("lang").alias("language"), F.lit("standard").alias("profile"), clean_display(F.col("text"), compose=False).alias("display_text")).where("display_text IS NOT NULL")


def word_tokens(scripts: DataFrame) -> DataFrame:
    """TOKEN rows: a token for each word, 60 ms per character, with faults by rule on the word's place.

    Jumps of 7 s every 211 words, a step back every 127, runs of no duration and of low confidence, and no confidence
    every 29 words.
    """
    words = scripts.select("script_id", F.posexplode(F.split("display_text", "[ \n]")).alias("pos", "text"))
    before = Window.partitionBy("script_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    placed = words.withColumn("start_char", F.coalesce(F.sum(F.length("text") + 1).over(before), F.lit(0)).cast("int")).where("text <> ''")
    order = Window.partitionBy("script_id").orderBy("pos")
    seen = F.coalesce(F.sum(F.length("text")).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    timed = placed.withColumn("ord", F.row_number().over(order) - 1).withColumn("seen", seen)
    div = lambda n: F.floor(F.col("ord") / n)
    begin = F.col("seen") * 60 + 7000 * div(211) - F.when(F.pmod("ord", F.lit(127)) == 126, 500).otherwise(0)
    lasts = F.when(F.pmod(div(8), F.lit(13)) == 5, 0).otherwise(F.length("text") * 60 - 10)
    confidence = F.when(F.pmod("ord", F.lit(29)) == 0, F.lit(None)).when(F.pmod(div(6), F.lit(11)) == 3, 0.05).otherwise(0.9)
    return timed.select(
        "script_id",
        "ord",
        "text",
        (F.greatest(F.lit(0), begin) / 1000.0).alias("start"),
        ((F.greatest(F.lit(0), begin) + lasts) / 1000.0).alias("end"),
        "start_char",
        (F.col("start_char") + F.length("text")).cast("int").alias("end_char"),
        confidence.cast("double").alias("confidence"),
    )


def with_duration(scripts: DataFrame) -> DataFrame:
    """Scripts with audio_duration: 60 ms per visible character and 8 s less than the jumps add, so that ends collapse."""
    return scripts.withColumn("audio_duration", visible_len(F.col("display_text")) * 60 / 1000.0)


def conversation_cues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """CUE rows: the pieces of each conversation's turns between full stops, commas and line ends."""
    turns = table(spark, sf_dir, "conversations")
    pieces = turns.select(F.col("conv_id").alias("script_id"), "turn", F.posexplode(F.split("text", "[.,\n]+ *")).alias("pos", "text"))
    order = Window.partitionBy("script_id").orderBy("turn", "pos")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    pieces = pieces.withColumn("idx", F.row_number().over(order)).withColumn("start_char", F.coalesce(F.sum(F.length("text") + 1).over(before), F.lit(0)).cast("int"))

    def by_place(values: tuple[int, ...]):
        return F.element_at(F.array(*map(F.lit, values)), (F.pmod("idx", F.lit(len(values))) + 1).cast("int"))

    pieces = pieces.withColumn("lasts", by_place(DURATIONS)).withColumn("gap", by_place(GAPS))
    start = F.coalesce(F.sum(F.col("lasts") + F.col("gap")).over(before), F.lit(0))
    return pieces.withColumn("begin", start).select(
        "script_id",
        "idx",
        (F.col("begin") / 1000.0).alias("start"),
        ((F.col("begin") + F.col("lasts")) / 1000.0).alias("end"),
        "text",
        "start_char",
        (F.col("start_char") + F.length("text")).cast("int").alias("end_char"),
        F.lit("en").alias("language"),
        F.lit("standard").alias("profile"),
    )


def conversation_scripts(cues: DataFrame) -> DataFrame:
    """script_id, display_text and compare_text: the pieces joined by spaces."""
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("idx", "text"))), lambda c: c["text"]), " ")
    return cues.groupBy("script_id").agg(joined.alias("display_text")).withColumn("compare_text", F.regexp_replace("display_text", "[ \n]+", ""))
