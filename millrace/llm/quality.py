"""Line-first quality rules, in DataFrame functions only.

Each ``\\n``-split line is judged by punctuation, navigation and boilerplate rules; failing lines are removed, and a
document that loses too much of its text is rejected. Everything is computed within the row: no shuffle, no Python.

Defined cases: a null text counts as an empty one (no words, ``base_failed``); rows are judged one by one, so repeated
ids and rows give repeated results; texts are read whole, however long, a line
as one value; an empty table gives an empty result; other columns of the input are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed values of the contract.
SPACE = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"
SYMBOL = r"[#*$%&|<>]"
WINDOW = 8
MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30

#: A line of at least this many characters without a lower-case letter is shouting; shorter ones may be headings.
SHOUT_CHARS = 60
#: A line of at least this many characters has to hold some punctuation.
UNPUNCTUATED_CHARS = 250
#: Percent of a line's characters that may be symbols.
MAX_LINE_SYMBOL_PERCENT = 8
#: Percent of a document's word characters that line rules may remove.
MAX_LOST_PERCENT = 50
# Menu entries and notices of sites in four languages.
#: Navigation: a short line that is one menu entry, or a run of labels between separators.
MENU_ENTRIES = (
    "home", "menu", "login", "log in", "sign in", "sign up", "register", "search", "contact( us)?", "about( us)?", "next", "previous", "back to top", "skip to content", "share( this)?", "read more", "subscribe",
    "startseite", "men[üÜ]", "anmelden", "registrieren", "suchen?", "kontakt", "impressum", "[üÜ]ber uns", "weiter", "zur[üÜ]ck", "nach oben", "zum inhalt( springen)?", "teilen", "weiterlesen", "mehr lesen", "abonnieren",
    "accueil", "connexion", "se connecter", "rechercher?", "contactez-nous", "[àÀ] propos", "suivant", "pr[éÉ]c[éÉ]dent", "haut de page", "aller au contenu", "partager", "lire la suite", "en savoir plus",
    "inicio", "men[úÚ]", "iniciar sesi[óÓ]n", "registrarse", "buscar", "contacto", "acerca de( nosotros)?", "siguiente", "anterior", "volver arriba", "ir al contenido", "compartir", "leer m[áÁ]s", "suscribirse",
)
MENU_ENTRY = r"(?i)^\W*(" + "|".join(MENU_ENTRIES) + r")\W*$"
MENU_ENTRY_CHARS = 40
MENU_SEPARATORS = (" | ", " » ", " › ", " · ", " > ")
MENU_RUN = r"( [|»›·>] \S+){3}"
#: Boilerplate: phrases of notices that belong to a site and not to its text, in lower case.
BOILERPLATE = (
    "lorem ipsum", "javascript", "all rights reserved", "terms of use", "terms of service", "privacy policy", "cookie policy", "uses cookies", "use of cookies",
    "alle rechte vorbehalten", "nutzungsbedingungen", "datenschutzerklärung", "verwendet cookies", "tous droits réservés", "politique de confidentialité", "utilise des cookies",
    "todos los derechos reservados", "términos de uso", "política de privacidad", "utiliza cookies",
)


def _words(text: Column) -> Column:
    return F.filter(F.split(text, SPACE + "+"), lambda w: w != "")


def _doubled(hashes: Column, step: int) -> Column:
    """Hashes of runs of 2*step words from hashes of runs of step words."""
    n = F.size(hashes) - step
    head, tail = F.slice(hashes, F.lit(1), F.greatest(n, F.lit(0))), F.slice(hashes, F.lit(step + 1), F.greatest(n, F.lit(0)))
    return F.zip_with(head, tail, lambda a, b: F.xxhash64(a, b))


def _covered(windows: Column) -> Column:
    """Words in windows whose hash occurs twice or more: the length of the union of their spans."""
    placed = F.sort_array(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    n = F.size(windows)
    shifted = F.slice(placed, F.lit(2), n)
    # neighbours in hash order: a pair with equal hashes marks both positions
    pairs = F.zip_with(F.slice(placed, F.lit(1), n - 1), shifted, lambda a, b: F.when(a["h"] == b["h"], F.array(a["i"], b["i"])))
    spots = F.sort_array(F.array_distinct(F.flatten(F.filter(pairs, lambda p: p.isNotNull()))))
    seen = F.aggregate(
        spots,
        F.struct(F.lit(-WINDOW).alias("at"), F.lit(0).cast("long").alias("n")),
        lambda acc, p: F.struct(p.alias("at"), (acc["n"] + F.least(F.lit(WINDOW), p - acc["at"])).alias("n")),
    )
    return seen["n"]


def _any_of(line: Column, phrases: tuple[str, ...]) -> Column:
    found = F.contains(line, F.lit(phrases[0]))
    for phrase in phrases[1:]:
        found = found | F.contains(line, F.lit(phrase))
    return found


def line_fails(line: Column) -> Column:
    """True where a line breaks a punctuation, navigation or boilerplate rule."""
    chars = F.length(line)
    noisy = (chars - F.length(F.regexp_replace(line, SYMBOL, ""))) * 100 > chars * MAX_LINE_SYMBOL_PERCENT
    shouting = (chars >= SHOUT_CHARS) & ~F.rlike(line, F.lit(r"\p{Ll}|\p{Lo}"))
    unpunctuated = (chars >= UNPUNCTUATED_CHARS) & ~F.rlike(line, F.lit(r"[.!?,;:…。।؟]"))
    menu = ((chars <= MENU_ENTRY_CHARS) & F.rlike(line, F.lit(MENU_ENTRY))) | (_any_of(line, MENU_SEPARATORS) & F.rlike(line, F.lit(MENU_RUN)))
    # one pattern, as nothing that is made of a line is kept between two expressions
    return noisy | shouting | unpunctuated | menu | F.rlike(F.lower(line), F.lit("|".join(BOILERPLATE)))


def quality_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Counts, verdicts and the cleaned text of every row of ``docs``.

    Columns: the id, ``n_words``, ``word_chars``, ``n_symbols``, ``n_dup_lines``, ``n_repeat_words`` (long),
    ``base_failed``, ``n_lines_removed``, ``lost_chars`` (word characters of removed lines), ``kept`` and
    ``clean_text`` (lines that passed, joined by ``\\n``).
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col), text.alias("text"))
    rows = rows.withColumn("words", _words(F.col("text")))
    rows = rows.select(
        id_col,
        F.size("words").cast("long").alias("n_words"),
        F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
        (F.length("text") - F.length(F.regexp_replace("text", SYMBOL, ""))).cast("long").alias("n_symbols"),
        F.filter(F.split("text", "\n"), lambda x: F.rlike(x, F.lit(r"[^\x20\x09-\x0D]"))).alias("full_lines"),
        F.transform("words", lambda w: F.xxhash64(w)).alias("h1"),
    )
    # one projection a step: each array is made once and read twice
    for step in (1, 2, 4):
        rows = rows.withColumn(f"h{2 * step}", _doubled(F.col(f"h{step}"), step)).drop(f"h{step}")
    rows = rows.withColumn("good_lines", F.filter("full_lines", lambda x: ~line_fails(x)))
    rows = rows.select(
        id_col,
        "n_words",
        "word_chars",
        "n_symbols",
        (F.size("full_lines") - F.size(F.array_distinct("full_lines"))).cast("long").alias("n_dup_lines"),
        F.when(F.size(F.array_distinct("h8")) == F.size("h8"), F.lit(0).cast("long"))
        .otherwise(_covered(F.col("h8")))
        .alias("n_repeat_words"),
        (F.size("full_lines") - F.size("good_lines")).cast("long").alias("n_lines_removed"),
        F.array_join("good_lines", "\n").alias("clean_text"),
    )
    left = F.length(F.regexp_replace("clean_text", SPACE + "+", ""))
    rows = rows.withColumn("lost_chars", F.when(F.col("n_lines_removed") == 0, F.lit(0).cast("long")).otherwise(F.col("word_chars") - left))
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    rows = rows.withColumn("base_failed", failed)
    lost = F.col("lost_chars") * 100 > F.col("word_chars") * MAX_LOST_PERCENT
    return rows.withColumn("kept", ~F.col("base_failed") & ~lost)


def op1_quality_rules(spark, sf_dir: str) -> DataFrame:
    """The contract's digest of :func:`quality_rules` over all ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return quality_rules(docs).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_lines_removed", "lost_chars"
    )
