import numpy as np
import pytest

from symvane.llm.language import LANGUAGES, Detector, labelled_sample, languages, source_languages
from symvane.llm.masks import PROSE, SOURCE, natural, prose


@pytest.fixture(scope="module")
def detector(spark):
    return Detector.fit(labelled_sample(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), "doc_id", "text", "lang"))


@pytest.mark.parametrize("machine", [PROSE, *SOURCE.values()])
def test_automaton_equals_a_plain_loop(machine):
    r = np.random.default_rng(4)
    data = r.choice(np.frombuffer(b"ab\"'`/*#-\n<>{}@~ \\\xff\xc3\xa9", np.uint8), 5000)
    want, state = [], machine.start
    for b in data:
        want.append(state)
        state = machine.table[state, machine.classes[b]]
    assert (machine.run(data) == np.array(want, np.uint8)).all()
    assert len(machine.run(data[:0])) == 0 and machine.run(data[:1]).tolist() == [machine.start]


def test_masks():
    comment, string = natural(['x = "say // hi"; // real comment\n/* a "b" */ y = \'c\';'], ["slash"])[0]
    assert comment.split() == ["real", "comment", "a", '"b"', "*/"] and string.split() == ["say", "//", 'hi"', "c'"]
    clean = prose(["/// Keeps `foo_bar` here, <b>bold</b>.\n/// @param x the x\n/// ```\n/// code here\n/// ```\n/// After it."])[0]
    assert "foo_bar" not in clean and "code here" not in clean and "After it." in clean and "param" not in clean and "bold" in clean
    assert prose(["", "é"]) == ["", "é"]


def test_held_out_accuracy(spark, detector):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    seen = {t for _, t in labelled_sample(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), "doc_id", "text", "lang")}
    rows = [(r.lang, r.text) for r in docs.filter("text IS NOT NULL AND doc_kind = 'note' AND pmod(xxhash64(doc_id), 2) = 0").select("lang", "text").collect() if r.lang in LANGUAGES and r.text not in seen]
    found = [max(d, key=lambda k: d[k][1]) if (d := x) else None for x in detector.languages([t for _, t in rows])]
    told = [(k, f) for (k, _), f in zip(rows, found) if f]
    assert len(told) > 1000 and sum(a == b for a, b in told) / len(told) > 0.93  # some labels are wrong


@pytest.mark.parametrize(("doc", "want"), [
    ("/// The caller must hold the lock.\n/// Quando falta a chave, o serviço cria a fila sem avisar.", {"en", "pt"}), ("TODO: docs", set()), ("@param some_name\n@returns", set()), ("fn load(x: &str) -> bool", set()),
    ("如果表中超过2行，读取者会等待mergeTrailingHeap完成。", {"zh"}), ("長すぎるパスに注意してください！", {"ja"}), ("ระวังเส้นทางที่ยาวเกินไป", {"th"}), ("Осторожно с длинными путями!", {"ru"}), ("   ", set()), ("a b", set()),
])
def test_docs(detector, doc, want):
    assert set(detector.languages([doc])[0]) == want


@pytest.mark.parametrize(("name", "want"), [
    ("openDirtyBucket", None), ("HTTPServer2Go", None), ("obtener_fecha_ruta_hoy", "es"), ("löscheGrößeAller", "de"), ("chargerListeVides", "fr"), ("carregarLinhasArquivos", "pt"), ("zagruzit_tablitsu_strok", "ru"),
    ("проверить_сумму_строк", "ru"), ("获取待处理文件列表", "zh"), ("設定を読み込む処理", "ja"), ("색인_다시_만들기", "ko"), ("größe", None), ("", None), ("___", None),
])
def test_names(detector, name, want):
    assert detector.name(name) == want


def test_frames(spark, detector):
    df = spark.createDataFrame([(1, "The caller must hold the lock.", "leerRutaHoy", "q"), (2, None, None, "q"), (3, "", "", None), (1, "The caller must hold the lock.", "leerRutaHoy", "q"), (4, "word " * 50_000, "x" * 50_000, "q")], "id long, doc string, name string, lang string")
    got = sorted((r.id, r.field, r.lang) for r in languages(df, "id", "doc", "name", detector).collect())
    assert got[:4] == [(1, "doc", "en"), (1, "doc", "en"), (1, "name", "es"), (1, "name", "es")] and {x[0] for x in got[4:]} <= {4}
    assert languages(df.limit(0), "id", "doc", "name", detector).collect() == []
    src = spark.createDataFrame([(1, '// The caller must hold the lock.\nx = "Primero se lee el índice y luego se cierra";', "slash"), (2, None, "slash"), (3, "", None)], "id long, text string, family string")
    assert sorted((r.part, r.lang) for r in source_languages(src, "id", "text", "family", detector).collect()) == [("comment", "en"), ("string", "es")]


def test_arrow_buffers_equal_lists():
    import pyarrow as pa

    texts = ["/// a b", None, "", "ünï 世界\n* c", "x"] * 3
    whole = pa.array(texts)
    assert prose(whole) == prose([t or "" for t in texts])
    assert prose(whole[2:9]) == prose([t or "" for t in texts[2:9]]) and prose(whole[:0]) == [] and prose(pa.array([None, None], pa.string())) == ["", ""]


def test_every_comment_form_of_documents(spark, detector):
    from symvane.llm.queries import comment_family

    forms = "-- Das Gewicht sinkt's \n * goes on here\n# hash mark\n\ufeff// slashes\nx = 1; /* a block */ y--;\n#[attr(z)]\n*p = q;\n```rust\n// in code 'x\n```\n"
    comment, string = natural([forms], ["mixed"])[0]
    assert comment.split() == ["Das", "Gewicht", "sinkt's", "goes", "on", "here", "hash", "mark", "slashes", "a", "block", "*/", "in", "code", "'x"] and not string.replace("`", "").split()
    assert natural(["--x;\n#include <a>\n * goes on"], ["star"])[0][0].split() == ["goes", "on"]
    assert natural(["x = `a\nb`;\n`c` ``` d"], ["mixed"])[0][1].split()[:3] == ["a", "b`", "c`"]
    german = "-- Das Gewicht sinkt nach 254 Tagen, und danach wird alles gelöscht.\n"
    rows = [(1, german, "source/a.md"), (2, german.replace("--", " *"), None), (3, "x = 1  " + german.replace("--", "#"), "a.py"), (4, "x = 1  " + german, "a.sql")]
    df = spark.createDataFrame(rows, "id long, text string, path string")
    got = source_languages(df.withColumn("family", comment_family(df.path)), "id", "text", "family", detector).collect()
    assert sorted((r.id, r.part, r.lang) for r in got) == [(i, "comment", "de") for i in (1, 2, 3, 4)]


@pytest.mark.parametrize(("doc", "want"), [
    ("Opens the file. Closes it again.", {"en": 6}), ("Opens files. Reads them. Done.", {"en": 5}), ("Opens files. Done.", {}), ("Opens the file. Closes it again. Öffnet die Datei. Schließt sie wieder.", {"en": 6, "de": 6}),
    ("この関数は returns the number of open files を呼び出してから、ファイルの内容をすべて読み込んで保存する。", {"en": 6, "ja": 0}), ("この関数は Buffer と Cache と Queue と Index を順番に読み込んで、あとで必ず保存する。", {"ja": 0}),
])
def test_short_and_mixed_sentences(detector, doc, want):
    found = detector.languages([doc])[0]
    assert {k: 0 if k == "ja" else w for k, (w, _) in found.items()} == want


def test_only_fenced_code_of_prose(spark, detector):
    from symvane.llm.masks import fenced_code

    text = "It's a \"quoted\" # word.\n```py\n# Das Gewicht sinkt nach vier Tagen immer weiter.\n```\nMore 'text'\n~~~\n// never closed but read here\n"
    assert fenced_code(text).split("\n") == ["", "", "# Das Gewicht sinkt nach vier Tagen immer weiter.", "", "", "", "// never closed but read here", ""] and fenced_code("") == ""
    df = spark.createDataFrame([(1, text, "fenced"), (2, "no code # here", "fenced")], "id long, text string, family string")
    assert sorted((r.id, r.part, r.lang) for r in source_languages(df, "id", "text", "family", detector).collect()) == [(1, "comment", "de"), (1, "comment", "en")]
