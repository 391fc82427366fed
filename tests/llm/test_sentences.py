import duckdb
import pytest

from symvane.llm.sentences import sentences, split_sentences


def cut(text):
    return [text[s:e] for s, e in sentences(text)]


def test_abbreviations_numbers_and_initials():
    assert cut("Mr. Ott took 2.5 ms, e.g. twice. J. K. Orm left at 11 p.m. Nobody saw it.") == ["Mr. Ott took 2.5 ms, e.g. twice.", "J. K. Orm left at 11 p.m.", "Nobody saw it."]
    assert cut("See No. 4, Fig. 2 and pp. 3 ff. of v. 2. It costs approx. 9.9 ms. After that it stops, etc. The end.") == ["See No. 4, Fig. 2 and pp. 3 ff. of v. 2.", "It costs approx. 9.9 ms.", "After that it stops, etc.", "The end."]
    assert cut("Am 3. Schritt bzw. danach, d. h. vorher, z. B. bei Abb. 2 und Nr. 4. Hr. Dr. Falk kam.") == ["Am 3. Schritt bzw. danach, d. h. vorher, z. B. bei Abb. 2 und Nr. 4.", "Hr. Dr. Falk kam."]
    assert cut("Según el Dr. Om, p. ej. hoy, etc. Después se borra. La Sra. Q. pidió más.")[0] == "Según el Dr. Om, p. ej. hoy, etc."
    assert cut("Осторожно с путями и т. д.! Судя по рис. 6, каждые 9 ч. работы.") == ["Осторожно с путями и т. д.!", "Судя по рис. 6, каждые 9 ч. работы."]


def test_quotations():
    assert cut('If it asks "is it dirty?" we answer. The note said "keep it." That is over.') == ['If it asks "is it dirty?" we answer.', 'The note said "keep it."', "That is over."]
    assert cut("“We keep it,” says x.py, “until it is full.” Then we stop.") == ["“We keep it,” says x.py, “until it is full.”", "Then we stop."]
    assert cut("Er schrieb: „Die Grenze liegt bei 9.“ Daran halten wir uns.") == ["Er schrieb: „Die Grenze liegt bei 9.“", "Daran halten wir uns."]
    assert cut("M. V. a noté : « rien ne change. Jamais ». Nous gardons.") == ["M. V. a noté : « rien ne change. Jamais ».", "Nous gardons."]
    assert cut("古いメモには「ここは変えない。」と書いてあります。次です。") == ["古いメモには「ここは変えない。」と書いてあります。", "次です。"]
    assert cut("旧的说明写着“不要修改。”现在不适用了。") == ["旧的说明写着“不要修改。”", "现在不适用了。"]


def test_scripts():
    assert cut("先读表……再写。好！") == ["先读表……", "再写。", "好！"]
    assert cut("यह सूची है। क्या? हाँ।") == ["यह सूची है।", "क्या?", "हाँ।"]
    assert cut("هل هذا؟ نعم. انتهى.") == ["هل هذا؟", "نعم.", "انتهى."]
    assert cut("แคชถูกเขียนก่อน ระวังเส้นทาง") == ["แคชถูกเขียนก่อน", "ระวังเส้นทาง"]
    assert cut("# การเปลี่ยนแปลง v2.1") == ["การเปลี่ยนแปลง v2.1"]
    assert cut("열쇠가 없으면 만듭니다. v1.2부터 씁니다.") == ["열쇠가 없으면 만듭니다.", "v1.2부터 씁니다."]


def test_lines_and_markers():
    text = "﻿# Title here\r\n\r\n- one item\r\n- two items\r\n\r\n> A quote runs\r\n> over lines. Next one.\r\n\r\n```py\nx. Y. z\n```\n// A comment\n// goes on. Done.\n\n1. First.\n2. Second one\n\nplain text\nwrapped here"
    assert cut(text) == ["Title here", "one item", "two items", "A quote runs\r\n> over lines.", "Next one.", "A comment\n// goes on.", "Done.", "First.", "Second one", "plain text\nwrapped here"]
    assert cut("Wait for step\n55. Then go on. (It is so.) End.") == ["Wait for step\n55.", "Then go on.", "(It is so.)", "End."]
    assert cut(" * Star comment of\n * two lines.\n\n* a list item\n* another") == ["Star comment of\n * two lines.", "a list item", "another"]
    assert cut("He said (see No. 3. here) and left. drop_it asks. docs/a.md: yes.") == ["He said (see No. 3. here) and left.", "drop_it asks.", "docs/a.md: yes."]
    assert cut("~~~\nnever closed. A b.\n") == []


def test_frame(spark):
    df = spark.createDataFrame([(1, "A b. C d."), (2, None), (3, ""), (4, " \n\t"), (5, "---"), (1, "A b. C d."), (6, "x " * 200_000 + "end.")], "doc_id long, text string").selectExpr("*", "'q' AS start_pos")
    got = sorted(tuple(r) for r in split_sentences(df, "doc_id", "text").collect())
    assert got == [(1, 0, 4), (1, 0, 4), (1, 5, 9), (1, 5, 9), (6, 0, 400_004)]
    assert split_sentences(df.limit(0), "doc_id", "text").collect() == []


def test_spans_are_ordered_and_trimmed():
    for (t,) in duckdb.sql("SELECT text FROM '/root/testdata/sf0.001/documents.parquet' WHERE text IS NOT NULL").fetchall():
        end = 0
        for s, e in sentences(t):
            assert end <= s < e and not t[s].isspace() and not t[e - 1].isspace()
            end = e


def test_thai_beside_other_scripts():
    assert cut("แคชถูกเขียนก่อน\nDer Aufrufer muss warten. ระวังเส้นทาง") == ["แคชถูกเขียนก่อน", "Der Aufrufer muss warten.", "ระวังเส้นทาง"]
    assert cut("แคช walk_tree ถูกเขียน CachedNode ก่อน") == ["แคช walk_tree ถูกเขียน CachedNode ก่อน"]
    assert cut("HOW MANY LOOPS DOES A. The caller waits.") == ["HOW MANY LOOPS DOES A.", "The caller waits."]


def test_titles_come_first():
    assert cut("O Sr. Quel pediu isso. El Sr. López y la Sra. Gil. Fin.") == ["O Sr. Quel pediu isso.", "El Sr. López y la Sra. Gil.", "Fin."]
    assert cut('"""Docstring here.\n\nMore text.\n"""') == ["Docstring here.", "More text."]


@pytest.mark.parametrize(("text", "want"), [
    ("1. Open the file\n - check the path\n2. Read it", ["Open the file", "check the path", "Read it"]),
    ("1. Open the file\n   1. check the path\n   2. check the size\n2. Read it\n3. Close it", ["Open the file", "check the path", "check the size", "Read it", "Close it"]),
    ("/// 1. Open the file\n///   - check the path\n///     - twice\n/// 2. Read it", ["Open the file", "check the path", "twice", "Read it"]),
    ("1. Open the file\n- check the path\n- check the size\n2. Read it", ["Open the file", "check the path", "check the size", "Read it"]),
    ("1. Open the file\n - check the rule\n   2. of the path\n2. Read it", ["Open the file", "check the rule\n   2. of the path", "Read it"]),
    ("1. Open the file, see rule\n5. of the path\n2. Read it", ["Open the file, see rule\n5. of the path", "Read it"]),
    ("- Open\n2. of it", ["Open\n2. of it"]),
])
def test_nested_lists(text, want):
    assert [text[s:e] for s, e in sentences(text)] == want
