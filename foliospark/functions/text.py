"""Text functions: romaji of kana, word wrap by a fixed advance, largest fitting size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Romaji of hiragana.
DIGRAPHS = {
    "きゃ": "kya", "きゅ": "kyu", "きょ": "kyo", "しゃ": "sha", "しゅ": "shu", "しょ": "sho", "ちゃ": "cha", "ちゅ": "chu", "ちょ": "cho",
    "にゃ": "nya", "にゅ": "nyu", "にょ": "nyo", "ひゃ": "hya", "ひゅ": "hyu", "ひょ": "hyo", "みゃ": "mya", "みゅ": "myu", "みょ": "myo",
    "りゃ": "rya", "りゅ": "ryu", "りょ": "ryo", "ぎゃ": "gya", "ぎゅ": "gyu", "ぎょ": "gyo", "じゃ": "ja", "じゅ": "ju", "じょ": "jo",
    "びゃ": "bya", "びゅ": "byu", "びょ": "byo", "ぴゃ": "pya", "ぴゅ": "pyu", "ぴょ": "pyo",
}
KANA = {
    "あ": "a", "い": "i", "う": "u", "え": "e", "お": "o", "か": "ka", "き": "ki", "く": "ku", "け": "ke", "こ": "ko",
    "さ": "sa", "し": "shi", "す": "su", "せ": "se", "そ": "so", "た": "ta", "ち": "chi", "つ": "tsu", "て": "te", "と": "to",
    "な": "na", "に": "ni", "ぬ": "nu", "ね": "ne", "の": "no", "は": "ha", "ひ": "hi", "ふ": "fu", "へ": "he", "ほ": "ho",
    "ま": "ma", "み": "mi", "む": "mu", "め": "me", "も": "mo", "や": "ya", "ゆ": "yu", "よ": "yo",
    "ら": "ra", "り": "ri", "る": "ru", "れ": "re", "ろ": "ro", "わ": "wa", "を": "wo", "ん": "n",
    "が": "ga", "ぎ": "gi", "ぐ": "gu", "げ": "ge", "ご": "go", "ざ": "za", "じ": "ji", "ず": "zu", "ぜ": "ze", "ぞ": "zo",
    "だ": "da", "ぢ": "ji", "づ": "zu", "で": "de", "ど": "do", "ば": "ba", "び": "bi", "ぶ": "bu", "べ": "be", "ぼ": "bo",
    "ぱ": "pa", "ぴ": "pi", "ぷ": "pu", "ぺ": "pe", "ぽ": "po", "ゃ": "ya", "ゅ": "yu", "ょ": "yo", "ぁ": "a", "ぃ": "i", "ぅ": "u", "ぇ": "e", "ぉ": "o",
}


def to_hiragana(text: Column) -> Column:
    """Katakana U+30A1..U+30F6 folded onto hiragana."""
    codes = range(0x30A1, 0x30F7)
    return F.translate(text, "".join(map(chr, codes)), "".join(chr(c - 0x60) for c in codes))


def romaji(text: Column) -> Column:
    """Upper-case romaji of kana; a small tsu doubles the next consonant, a long mark the vowel before it."""
    table = F.create_map(*[F.lit(x) for pair in (DIGRAPHS | KANA).items() for x in pair])
    tokens = F.regexp_extract_all(to_hiragana(text), F.lit("(?s)" + "|".join(DIGRAPHS) + "|."), 0)

    def step(s: Column, t: Column) -> Column:
        double = F.when(s["small"], F.substring(F.coalesce(F.try_element_at(table, F.substring(t, 1, 1)), F.lit("")), 1, 1)).otherwise("")
        sound = F.coalesce(F.try_element_at(table, t), t)
        vowel = F.regexp_extract(s["out"], "([aeiou])$", 1)
        out = F.when(t == "っ", F.concat(s["out"], double)).when(t == "ー", F.concat(s["out"], vowel)).otherwise(F.concat(s["out"], double, sound))
        return F.struct(out.alias("out"), (t == "っ").alias("small"))

    return F.upper(F.aggregate(tokens, F.struct(F.lit("").alias("out"), F.lit(False).alias("small")), step, lambda s: s["out"]))


def wrapped(text: Column, max_chars: Column, chunk: int = 512) -> Column:
    """Lines of a greedy wrap where every character is as wide as another; a word wider than a line is cut.

    A fold copies its state at every step, so words are folded in chunks and a chunk's lines are added at its end.
    """
    state = "struct<lines:array<string>,cur:string>"
    none = F.array().cast("array<string>")

    def broken(w: Column) -> Column:
        n = F.ceil(F.length(w) / max_chars).cast("int")
        return F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.substring(w, i * max_chars + 1, max_chars))

    def step(s: Column, w: Column) -> Column:
        joined = F.when(s["cur"] == "", w).otherwise(F.concat(s["cur"], F.lit(" "), w))
        flushed = F.when(s["cur"] == "", s["lines"]).otherwise(F.concat(s["lines"], F.array(s["cur"])))
        cut = broken(w)
        fits = F.struct(s["lines"].alias("lines"), joined.alias("cur")).cast(state)
        fresh = F.struct(flushed.alias("lines"), w.alias("cur")).cast(state)
        many = F.struct(F.concat(flushed, F.slice(cut, 1, F.size(cut) - 1)).alias("lines"), F.element_at(cut, -1).alias("cur")).cast(state)
        return F.when(F.length(joined) <= max_chars, fits).when(F.length(w) <= max_chars, fresh).otherwise(many)

    def begun(cur: Column) -> Column:
        return F.struct(none.alias("lines"), cur.alias("cur")).cast(state)

    def of_chunk(s: Column, words: Column) -> Column:
        done = F.transform(F.array(F.aggregate(words, begun(s["cur"]), step)), lambda d: F.struct(F.concat(s["lines"], d["lines"]).alias("lines"), d["cur"].alias("cur")).cast(state))
        return F.get(done, F.lit(0))

    def of_words(words: Column) -> Column:
        chunks = F.transform(F.sequence(F.lit(1), F.greatest(F.size(words), F.lit(1)), F.lit(chunk)), lambda i: F.slice(words, i, chunk))
        lines = F.aggregate(chunks, begun(F.lit("")), of_chunk, lambda s: F.when(s["cur"] == "", s["lines"]).otherwise(F.concat(s["lines"], F.array(s["cur"]))))
        return F.when(F.size(words) > 0, lines).otherwise(F.array(F.lit("")))

    words = F.filter(F.split(text, r"\s+"), lambda w: w != "")
    return F.get(F.transform(F.array(words), of_words), F.lit(0))


def fit_size(rows: DataFrame, max_size: int, min_size: int, padding: float = 0.0) -> DataFrame:
    """rows(.., text, w, h) with font_size, n_lines and overflow: the largest size whose wrapped block fits the box.

    A character of size s is s / 2 wide and a line s high. If none fits, the least size with overflow true. Sizes are
    tried in the row, by a fold that stops wrapping once one fits.
    """
    sizes = F.sequence(F.lit(max_size), F.lit(min_size), F.lit(-1))

    def step(s: Column, z: Column) -> Column:
        per_line = F.greatest(F.lit(1), F.floor(2 * (F.col("w") - 2 * padding) / z)).cast("int")
        n = F.size(wrapped(F.col("text"), per_line))
        fits = (n * z <= F.col("h") - 2 * padding) & (F.col("w") - 2 * padding >= z / F.lit(2.0))
        return F.when(s["done"], s).otherwise(F.struct(fits.alias("done"), z.alias("size"), n.alias("n")))

    best = F.aggregate(sizes, F.struct(F.lit(False).alias("done"), F.lit(0).alias("size"), F.lit(0).alias("n")), step)
    return rows.withColumn("_b", best).withColumn("font_size", F.col("_b.size")).withColumn("n_lines", F.col("_b.n")).withColumn("overflow", ~F.col("_b.done")).drop("_b")
