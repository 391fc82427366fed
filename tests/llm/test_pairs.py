import pytest

from symvane.llm.pairs import code_doc_pairs, functions, informative, stored_pairs

RUST = """/// Adds two numbers.
#[inline]
pub fn add(a: i32, b: i32) -> i32 {
    if a > 0 { a + b } else { b }
}

// Far away.


fn bare() {}
"""
PYTHON = '''class A:
    def run(self, x):
        """Runs the thing until it stops."""
        def inner():
            pass
        return x

# Says hello to everyone.
def hello(): return 1
'''
RUBY = """# Drops the whole table.
def drop(x)
  if x
    x.each do |y|
      y
    end
  end
end
def other; 1; end
"""


def test_extraction():
    got = functions(RUST)
    assert [(f.name, f.line, f.end_line, f.doc) for f in got] == [("add", 3, 5, "/// Adds two numbers."), ("bare", 10, 10, "")]
    got = {f.name: f for f in functions(PYTHON)}
    assert got["run"].end_line == 6 and "until it stops" in got["run"].doc and got["inner"].end_line == 5 and got["hello"].doc == "# Says hello to everyone."
    got = {f.name: f for f in functions(RUBY)}
    assert got["drop"].end_line == 8 and got["drop"].doc == "# Drops the whole table."
    block = functions("/**\n * Opens it.\n * @param x\n */\npublic static void open(int x) {\n  {\n  }\n}\n")[0]
    assert block.name == "open" and block.end_line == 8 and "Opens it." in block.doc
    assert functions("") == [] and functions("x = 1\nreturn foo(1)\nif (a) {\n}\n") == []


@pytest.mark.parametrize("doc", [None, "", " \n", "TODO", "// FIXME: describe", "/** */", "n/a", "-", "...", "(none)", "====", "@param x\n@return", "{@inheritDoc}", "<summary></summary>", "@see Other", "待办", "À compléter", "ЗАДАЧА: описать",
                                 "Drop record.", "Drops the record", "This method is used in order to drop record.", "The drop record.", "fn drop_record(x: &str) -> bool", "```\nlet x = 1;\n```", "Licensed under the project terms; see the notice.", "Generated by the schema step; do not edit this by hand.", "<summary>Gets the drop record.</summary>"])
def test_says_nothing(doc):
    assert not informative(doc, "drop_record", "fn drop_record(x: u8)")


@pytest.mark.parametrize("doc", ["Drops the record unless it is locked.", "/// Safe to call twice.", "@param x the number of rows to skip", "Panics when the tree is empty.", "缺少键时，服务会直接新建表格！", "너무 긴 경로는 조심하세요!", "/**\n * Never call this from the main thread!\n */", "See docs/a.md for the details of locking."])
def test_says_something(doc):
    assert informative(doc, "drop_record", "fn drop_record(x: u8)")


def test_frames(spark):
    df = spark.createDataFrame([(1, "add", "fn add()", "Sums all rows twice."), (2, "add", "fn add()", "Add."), (3, "add", "fn add()", None), (4, None, None, "Sums all rows twice."), (1, "add", "fn add()", "Sums all rows twice."), (5, "add", "odd {", "// Sums\n// all rows " * 2000)], "id long, name string, signature string, doc string")
    assert sorted(r.id for r in stored_pairs(df, "id", "name", "signature", "doc").collect()) == [1, 1, 4, 5]
    assert stored_pairs(df.limit(0), "id", "name", "signature", "doc").collect() == []
    src = spark.createDataFrame([(1, RUST, "n"), (2, None, "n"), (3, "", "n")], "id long, text string, name string")
    assert [(r.id, r.name) for r in code_doc_pairs(src, "id", "text").collect()] == [(1, "add")]


@pytest.mark.parametrize(("doc", "name", "want"), [
    ("Converts 円 amounts into dollars at the rate of the day", "convert", True), ("/// 排序表", "run", True), ("/// 待办", "run", False), ("要修正", "run", False), ("TODO: 待补充", "run", False), ("/// 排序表", "排序表", False), ("円", "run", False), ("Converts 円", "converts", False),
    ("如果表中超过两行就等待", "run", True),
])
def test_docs_of_several_scripts(doc, name, want):
    assert informative(doc, name, f"def {name}(x)") is want


@pytest.mark.parametrize(("source", "signature", "doc", "lines"), [
    ('def load(\n    path: str,  # where (it is\n    mode: str = ")",\n) -> int:\n\n    """Reads the table from disk."""\n    return 1\n\nx = 2\n', 'def load(path: str, mode: str = ")",) -> int:', '    """Reads the table from disk."""', (1, 7)),
    ('def load(a):\n\n    """Reads the table from disk."""\n    return 1\n', "def load(a):", '    """Reads the table from disk."""', (1, 4)),
    ("/// Reads the table from disk.\npub fn load(\n    path: &str,\n    mode: u8,\n) -> bool {\n    if mode { 1 }\n}\n", "pub fn load(path: &str, mode: u8,) -> bool", "/// Reads the table from disk.", (2, 7)),
    ("class A {\n  // Reads the table from disk.\n  load(\n    path: string,\n  ): void {\n    x();\n  }\n}\n", "load(path: string,): void", "  // Reads the table from disk.", (3, 7)),
    ("# Reads the table from disk.\ndef load(a,\n         b)\n  a + b\nend\n", "def load(a, b)", "# Reads the table from disk.", (2, 5)),
    ("# Reads the table from disk.\ndef load(\ndef other(a):\n    pass\n", "def load(", "# Reads the table from disk.", None),
])
def test_signatures_over_several_lines(source, signature, doc, lines):
    f = functions(source)[0]
    assert (f.signature, f.doc) == (signature, doc) and lines in (None, (f.line, f.end_line))


PLANTED = """# Notes on reading

When rankRibbon (see the guide) runs first, the reader leaves the table (about 5.52 kB).
Note that fetch_row(x) may return nothing, and func (the old one) is gone.
/// Opens the table and holds its lock.

```py
# Sorts the rows by their owner.
def sort_rows(rows):
    return sorted(rows)

def bare(rows):
    return rows
```

int total (of all rows) is what it returns {

```c
/* Frees every page of the pool. */
static void free_pool(struct pool *p)
{
    for (;;) { break; }
}
```
~~~lua
-- Adds one row at the end.
function add(t)
  if t then
    t.n = 1
  end
end
local x = add(1)
~~~
~~~ts
// Waits until the queue is empty.
export const drain = async (q: Queue): Promise<void> => {
  while (q.size) { await q.next(); }
};
class A {
  // Closes the file twice, safely.
  close(force: boolean): void {
    x(() => { y(); });
  }
}
~~~
"""


def test_prose_declares_nothing_and_fences_part_code():
    got = {f.name: f for f in functions(PLANTED)}
    assert {n: (f.line, f.end_line) for n, f in got.items()} == {"sort_rows": (9, 10), "bare": (12, 13), "free_pool": (20, 23), "add": (27, 31), "drain": (36, 38), "close": (41, 43)}
    assert {n: bool(f.doc) for n, f in got.items()} == {"sort_rows": True, "bare": False, "free_pool": True, "add": True, "drain": True, "close": True}
    assert functions("/// Opens it all.\n```\nfn a() {\n```\n}\nfn b() {}\n")[0].end_line == 3  # neither comment nor body crosses a fence
    assert functions("/// Opens it all.\n```\nfn a() {\n```\n")[0].doc == ""


def test_precision_and_recall_on_documents():
    import re

    import duckdb

    rows = duckdb.sql("SELECT text FROM '/root/testdata/sf0.01/documents.parquet' WHERE text IS NOT NULL").fetchall()
    want = found = both = 0
    for (text,) in rows:  # planted functions stand at the start of a line, with a keyword and a bracket; prose holds none
        lines = {k + 1 for k, x in enumerate(re.split(r"\r\n|\n|\r", text)) if re.match(r"\s*(?:def|fn|func|function)\s+\w+\s*\(", x)}
        got = {f.line for f in functions(text)}
        want, found, both = want + len(lines), found + len(got), both + len(lines & got)
    assert want > 300 and both / want >= 0.98 and both / found >= 0.98


def test_attachment_decides():
    assert [f.doc for f in functions("// Opens it.\n\n\n\nodd one\n", {5: "odd"})] == [""]
    assert [(f.name, f.doc) for f in functions("// Opens it.\nodd one\n", {2: "odd"})] == [("odd", "// Opens it.")]
