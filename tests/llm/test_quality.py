import re
from collections import Counter

from millrace.llm.quality import quality_rules

SCHEMA = "doc_id long, text string, n_words string, lines int"


def brute(text):
    t = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", t)
    windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    seen = Counter(windows)
    covered = {i + k for i, w in enumerate(windows) if seen[w] > 1 for k in range(8)}
    lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(covered)


PROSE = "The quick brown fox jumps over the lazy dog, and then it rests under a tall tree for some time. "


def test_counts_equal_brute_force(spark):
    texts = [None, "", "   \n\t\x0b", "a", PROSE * 3, "x y " * 50, "# * $ | <a>\n" * 3, PROSE + "\n" + PROSE, "é ü 漢字 🙂 " * 9, "w" * 200_000, " ".join(map(str, range(5000))) + " " + " ".join(map(str, range(40)))]
    df = spark.createDataFrame([(i, t, "clash", 1) for i, t in enumerate(texts)], SCHEMA)
    rows = {r.doc_id: r for r in quality_rules(df).collect()}
    for i, t in enumerate(texts):
        r = rows[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == brute(t), i
        n, *_, repeats = brute(t)
        assert r.base_failed == (n < 20 or 100 * repeats > 30 * n)
        assert not (r.base_failed and r.kept)


def test_line_rules(spark):
    good = PROSE + "Nobody knows why it came here, but everyone agrees that it is welcome to stay for supper."
    rows = [
        (1, good, "", 0),
        (2, "\n".join([good] + ["we use cookies, see our cookie policy and terms of use " * 3] * 6), "", 0),
        (3, "\n".join([good, "Home", "Contact us", "Log in"]), "", 0),
        (4, "word### other$$$ third%%% " * 12, "", 0),
        (5, "\n".join(["Home | News | Sport | Weather | About"] * 9 + ["Intro text ends here."]), "", 0),
    ]
    got = {r.doc_id: r for r in quality_rules(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got[1].kept and got[1].n_lines_removed == 0 and got[1].clean_text == good
    assert not got[2].kept
    assert got[3].kept and got[3].n_lines_removed == 3 and got[3].clean_text == good
    assert not got[4].kept and not got[5].kept


def test_repeated_rows_and_empty_table(spark):
    df = spark.createDataFrame([(1, PROSE, "", 0)] * 3, SCHEMA)
    assert quality_rules(df).count() == 3
    assert quality_rules(df.limit(0)).count() == 0


def test_no_python_in_the_plan(spark):
    df = quality_rules(spark.createDataFrame([(1, PROSE, "", 0)], SCHEMA).select("doc_id", "text"))
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_menus_and_notices_of_four_languages(spark):
    gone = ["Impressum", "« Zurück »", "ÜBER UNS", "Lire la suite", "À PROPOS", "précédent", "Iniciar sesión", "MENÚ", "Leer más", "Read more", "Alle Rechte vorbehalten, 2024.", "© Tous Droits réservés.", "Esta página utiliza cookies."]
    stays = ["Zurück in der Stadt.", "Le menu du jour, en détail.", "Buscar la verdad es difícil.", "Search for the truth, always."]
    df = spark.createDataFrame([(i, t, "", 0) for i, t in enumerate([*gone, *stays])], SCHEMA)
    got = {r.doc_id: r.clean_text for r in quality_rules(df).collect()}
    assert [got[i] for i in range(len(gone))] == [""] * len(gone) and [got[len(gone) + i] for i in range(len(stays))] == stays
