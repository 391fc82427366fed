import time

import pytest

from symvane.sources.extract import extract

SAMPLES = {
    "rust": """use a::b;
/// Holds rows.
#[derive(Debug)]
pub struct Table<T> { rows: Vec<T> }
pub trait Reader: Base + Send {
    /// Reads one.
    fn read(&self) -> Row;
}
impl<T> Reader for Table<T> {
    fn read(&self) -> Row { let x = self.rows.first(); log!("x {}", x); helper::<T>(); Row { n: count(x) } }
}
mod inner { pub(crate) async fn deep(a: &'static str) {} }
const MAX: usize = 4;
macro_rules! twice { ($x:expr) => { $x; $x } }
enum Kind { One(u8), Two { a: u8 } }
""",
    "typescript": """export abstract class Store<T extends Row> extends Base implements Reader, Closer {
  private size = 0;
  constructor(readonly log: Logger) { super(); }
  /** Adds one. */
  public async add(row: T): Promise<void> {
    const o = { a: 1, b: () => { this.log.info(row); } };
    new Map<string, T>(); send(o);
  }
  #hide = (x: number) => x + 1
}
export const run = async (q: Queue) => { await q.next() }
export interface Reader { read(n: number): Row; }
type Id = string | number
namespace Deep { export function check(u: User): boolean { return u.ok() } }
let state = null
""",
    "go": """package main

// Line is one.
type Line struct {
	Base
	n int
}
type Reader interface {
	Read(n int) error
}
const (
	A = 1
	b = 2
)
var X = map[string]int{"a": 1}

// Add adds.
func (l *Line) Add(o Line) error {
	fmt.Println(o)
	if x := f(func() int { return g() }); x > 1 { h() }
	return nil
}
func New() *Line { return &Line{} }
""",
    "java": """package a.b;
/** A cart. */
@Entity(name = "c")
public class Cart<T> extends Base<T> implements Closer {
  private static final int MAX = 5;
  public Cart() { super(); }
  @Override protected <U> List<U> copy(Map<String, U> m) { return Util.copy(m, x -> { return hide(x); }); }
  enum State { A, B }
  interface Seen { void done(); }
}
""",
    "csharp": """namespace Shop.Billing {
  [Serializable]
  public class Invoice : BaseInvoice, IPriced {
    public const int Max = 5;
    public Invoice(string c) { Init(c); }
    internal static int Sum(int a) => Add(a, 1);
  }
}
""",
    "c": """#include <a.h>
#define CAP 5
#define MASK(x) ((x) & 1)
/* A ring. */
typedef struct Ring { int n; } Ring;
static int used = 0;
/* Makes one. */
Ring *ring_new(int n) { if (n > 1) { log_it(n); } return malloc(n); }
int proto(int);
""",
    "cpp": """namespace geo {
template <typename T> class Shape : public Base<T> {
 public:
  Shape() = default;
  virtual ~Shape() {}
  double area() const;
 private:
  void hide() {}
};
}
double geo::Shape::area() const { return calc(1); }
""",
    "php": """<?php
namespace Shop;
/** Bill. */
#[Entity]
final class Bill extends Model implements Priced {
  const MAX = 5;
  public function add(Line $l): static { $this->check($l); return round_it($l); }
  private function check($l) {}
}
function top($x) { return new Bill($x); }
""",
}
WANT = {
    "rust": ["struct Table", "interface Reader", "method Reader::read", "method Table::read", "module inner", "function inner::deep", "constant MAX", "macro twice", "enum Kind"],
    "typescript": ["class Store", "method Store.constructor", "method Store.add", "method Store.#hide", "function run", "interface Reader", "method Reader.read", "type Id", "module Deep", "function Deep.check", "variable state"],
    "go": ["struct Line", "interface Reader", "method Reader.Read", "constant A", "constant b", "variable X", "method Line.Add", "function New"],
    "java": ["class Cart", "constant Cart.MAX", "method Cart.Cart", "method Cart.copy", "enum Cart.State", "interface Cart.Seen", "method Cart.Seen.done"],
    "csharp": ["module Shop.Billing", "class Shop.Billing.Invoice", "constant Shop.Billing.Invoice.Max", "method Shop.Billing.Invoice.Invoice", "method Shop.Billing.Invoice.Sum"],
    "c": ["macro CAP", "macro MASK", "struct Ring", "variable used", "function ring_new"],
    "cpp": ["module geo", "class geo::Shape", "method geo::Shape::Shape", "method geo::Shape::~Shape", "method geo::Shape::area", "method geo::Shape::hide", "method geo::Shape::area"],
    "php": ["module Shop", "class Bill", "constant Bill::MAX", "method Bill::add", "method Bill::check", "function top"],
}
CALLS = {
    "rust": {("read", "first", "self.rows"), ("read", "log", None), ("read", "count", None)}, "typescript": {("add", "info", "this.log"), ("add", "send", None), ("run", "next", "q"), ("check", "ok", "u")}, "go": {("Add", "Println", "fmt"), ("Add", "f", None), ("Add", "g", None), ("Add", "h", None)},
    "java": {("copy", "copy", "Util"), ("copy", "hide", None)}, "csharp": {("Invoice", "Init", None), ("Sum", "Add", None)}, "c": {("ring_new", "log_it", None), ("ring_new", "malloc", None)}, "cpp": {("area", "calc", None)}, "php": {("add", "check", "$this"), ("add", "round_it", None)},
}
INHERITS = {"rust": {("Reader", "Base"), ("Reader", "Send"), ("Table", "Reader")}, "typescript": {("Store", "Base"), ("Store", "Reader"), ("Store", "Closer")}, "java": {("Cart", "Base"), ("Cart", "Closer")}, "csharp": {("Invoice", "BaseInvoice"), ("Invoice", "IPriced")}, "php": {("Bill", "Model"), ("Bill", "Priced")}, "cpp": {("Shape", "Base")}}
DOCS = {"rust": {"Table": "Holds rows."}, "typescript": {"add": "Adds one."}, "go": {"Line": "Line is one.", "Add": "Add adds."}, "java": {"Cart": "A cart."}, "c": {"Ring": "A ring.", "ring_new": "Makes one."}, "php": {"Bill": "Bill."}}


@pytest.mark.parametrize("language", SAMPLES)
def test_samples(language):
    text = SAMPLES[language]
    found = extract(text, language)
    assert [f"{s['kind']} {s['qualified_name']}" for s in found.symbols] == WANT[language] and found.parse_errors == 0
    name = lambda r: found.symbols[r["owner_seq"]]["name"] if r["owner_seq"] is not None else None
    assert CALLS[language] <= {(name(r), r["name"], r["qualifier"]) for r in found.refs if r["kind"] == "call"}
    assert {(name(r), r["name"]) for r in found.refs if r["kind"] == "inherit"} >= INHERITS.get(language, set())
    for s in found.symbols:
        assert text.encode()[s["start_byte"] : s["end_byte"]].decode().count("\n") == s["end_line"] - s["start_line"]
        if s["parent_seq"] is not None:
            assert s["qualified_name"].startswith(found.symbols[s["parent_seq"]]["qualified_name"])
    first = {s["name"]: s["doc"] for s in reversed(found.symbols)}
    assert {n: first[n] for n in DOCS.get(language, {})} == DOCS.get(language, {})


def test_visibility_and_signatures():
    rust = {s["qualified_name"]: s for s in extract(SAMPLES["rust"], "rust").symbols}
    assert rust["Table"]["visibility"] == "public" and rust["Table"]["signature"] == "pub struct Table<T>" and rust["Table::read"]["visibility"] == "private" and rust["Reader::read"]["visibility"] == "public" and rust["MAX"]["signature"] == "const MAX: usize = 4"
    go = {s["name"]: s for s in extract(SAMPLES["go"], "go").symbols}
    assert go["A"]["visibility"] == "public" and go["b"]["visibility"] == "private" and go["Add"]["signature"] == "func (l *Line) Add(o Line) error"
    java = {s["name"]: s for s in extract(SAMPLES["java"], "java").symbols}
    assert java["copy"]["signature"].startswith("protected <U> List<U> copy") and java["copy"]["visibility"] == "private" and java["copy"]["outline"] == ["copy", "hide"]
    ts = {s["name"]: s for s in extract(SAMPLES["typescript"], "typescript").symbols}
    assert ts["#hide"]["visibility"] == "private" and ts["add"]["visibility"] == "public" and ts["state"]["visibility"] == "private"


def test_c_that_is_cpp_is_read_again():
    found = extract(SAMPLES["cpp"], "c")
    assert "class geo::Shape" in [f"{s['kind']} {s['qualified_name']}" for s in found.symbols]


@pytest.mark.parametrize("language", SAMPLES)
@pytest.mark.parametrize("text", ["", "{" * 30_000, "}" * 30_000, "(" * 30_000, "x = [" + "{a: 1}," * 20_000, '"' * 30_001, "'" * 30_001, "/*" * 15_000, "#" * 30_000, "<" * 30_000, "a." * 20_000, "f(" * 20_000, "fn f() {\n" * 5_000, "class A {\n" * 5_000, "\n" * 50_000, "const x = 1\n" * 5_000, "`" * 3_001, "\x00\xff", "a b " * 20_000, "::" * 20_000, "@a(" * 10_000])
def test_odd_texts_take_linear_time(language, text):
    start = time.process_time()
    extract(text, language)
    assert time.process_time() - start < 3
