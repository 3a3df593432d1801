"""The lexer against literal files, and its invariants on random ones."""

import random

import pytest

from weftgraph.functions.lexer import lex
from weftgraph.operators import extract as X

TS = '''export function f(a: { b: string }): { c: number } {
  const s = "{"; // }
  const t = `x ${a ? `{${s}` : "}"} } {`;
  const r = /[{/]+\\/{/g.test(s) / 2;
  return <p>Don't {s}</p>;
}
export const g = (n: number): number =>
  n

  // between
  + 1;
export const h = async () => {
  return { a: 1 };
}
type T =
  | { a: string }
  | { b: number };
/* function no() {
*/
function over(a: string): void;
const text = `
function inner() {
`;
function last() {
  /* {{{ */
'''


def test_spans_of_literal_file():
    code, braced, plain = lex(TS, "typescript")
    lines = TS.split("\n")
    assert braced[0] == 5 and plain[6] == 10 and braced[11] == 13 and plain[11] == 13 and plain[14] == 16 and braced[19] == 19
    assert braced[23] == len(lines) - 1  # never closed
    blanked = code.split("\n")
    assert "no" not in blanked[17] and blanked[21].strip("_") == "" and blanked[24].strip() == ""


def test_strings_with_brackets_end_where_they_should(spark):
    rows = [("r", "a.ts", 'function a() {\n  const s = "{";\n  return s;\n}\n' + "const z = 1;\n" * 5), ("r", "b.ts", None), ("r", "c.ts", "")]
    found = X.ts_nodes(spark.createDataFrame(rows, "repo string, path string, content string")).collect()
    assert [(r["name"], r["start_line"], r["end_line"]) for r in found] == [("a", 1, 4)]


def test_doc_and_declarations_inside_text_are_left_out(spark):
    text = 'class A {\n  String t = """\n  /** no */\n  void ghost() {\n  """;\n  /** Yes { */\n  @Get("}")\n  int b() { return 1; }\n  /* int old() { */\n}\n'
    files = spark.createDataFrame([("r", "A.java", text)], "repo string, path string, content string")
    assert [(r["name"], r["start_line"], r["end_line"], r["docstring"]) for r in X.java_methods(files).collect()] == [("b", 7, 8, "/** Yes { */")]
    assert [(r["start_line"], r["end_line"]) for r in X.java_classes(files).collect()] == [(1, 10)]


@pytest.mark.parametrize("seed", range(150))
def test_blanked_text_keeps_length_and_lines(seed):
    r = random.Random(seed)
    parts = ["{", "}", "(", ")", "[", "]", ";", "\n", "\n", "'", '"', "`", "${", "//", "/*", "*/", "/", "\\", '"""', "a", "return ", "=>", "=", ":", " ", "é"]
    text = "".join(r.choice(parts) for _ in range(r.randrange(0, 120)))
    for language in ("typescript", "java"):
        code, braced, plain = lex(text, language)
        lines = text.split("\n")
        assert len(code) == len(text) and [i for i, c in enumerate(code) if c == "\n"] == [i for i, c in enumerate(text) if c == "\n"]
        assert len(braced) == len(plain) == len(lines)
        assert all(i <= e < len(lines) for ends in (braced, plain) for i, e in enumerate(ends))


def test_long_files_take_linear_time():
    import time

    started = time.perf_counter()
    for piece in ("{", "a\n", "`${", "'", "/", '"""\\', "/*", "a = (\n", "\n"):
        for language in ("typescript", "java"):
            lex(piece * 100_000, language)
    assert time.perf_counter() - started < 60
