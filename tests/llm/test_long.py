import time

import pytest

from symvane.llm.language import latin_prose, runs_of
from symvane.llm.leakage import readings
from symvane.llm.masks import natural, prose
from symvane.llm.pairs import functions, informative
from symvane.llm.sentences import sentences

TEXTS = {
    "blanks": "a" + " " * 100_000 + "b. C d.", "unmatched": "(“«[" * 25_000 + "a. B c." + ")" * 100_000, "closers": "(" * 50_000 + "”" * 50_000 + "a. B", "numbers": "".join(f"{i}. step " for i in range(50_000)), "letters": "A. " * 50_000, "stops": ". " * 50_000 + "a",
    "semicolons": ";" * 100_000 + "x", "slashes": "/" * 100_000 + "x", "notes": "<!-- a " * 20_000, "letters_run": "a" * 100_000, "accents": "é" * 100_000, "parted": "foo-\n" + "/" * 100_000 + "9", "stars": "*" * 100_000, "braces": "f(a) {\n" * 15_000, "open_calls": "foo(\n" * 15_000,
    "prose_call": "int foo(" + "x " * 50_000 + "; y", "defs": "def f(\n" * 15_000, "quotes": '"' + " " * 100_000, "pointer": "see a" + "." * 100_000 + " x y", "tag": "{@" + "a" * 100_000, "nested": "".join(" " * i + f"def f{i}():\n" for i in range(400)),
}
WORK = {
    "sentences": sentences, "readings": readings, "runs": lambda t: (runs_of(t), latin_prose(t)), "masks": lambda t: (prose([t]), natural([t], ["mixed"])), "informative": lambda t: informative(t, "foo", "fn foo()"), "functions": functions,
}


@pytest.mark.parametrize("work", WORK)
@pytest.mark.parametrize("text", TEXTS)
def test_long_texts_take_linear_time(work, text):
    start = time.process_time()
    WORK[work](TEXTS[text])
    assert time.process_time() - start < 2
