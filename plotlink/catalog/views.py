"""Named SQL views with transitive resolution, rendered for Spark or DuckDB.

The fixture views are projections both engines can run, so their text is written once. The
few spots where the engines differ are written as tokens: ``@SEQ(a,b)@`` (one row per
integer), ``@EPOCH_US(x)@`` and ``@JOINED(text;order)@`` (comma-joined aggregate).
"""

import re

BASE_TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()

_RULES = {
    "spark": [
        (r"@SEQ\(([^@]*)\)@", r"explode(sequence(\1))"),
        (r"@EPOCH_US\(([^@]*)\)@", r"unix_micros(cast(\1 as timestamp))"),
        (r"@JOINED\(([^@]*);([^@]*)\)@", r"listagg(\1, ',') WITHIN GROUP (ORDER BY \2)"),
    ],
    "duckdb": [
        (r"@SEQ\(([^@]*)\)@", r"unnest(generate_series(\1))"),
        (r"@EPOCH_US\(([^@]*)\)@", r"epoch_us(\1)"),
        (r"@JOINED\(([^@]*);([^@]*)\)@", r"string_agg(\1, ',' ORDER BY \2)"),
    ],
}


def render(text: str, engine: str) -> str:
    for pattern, repl in _RULES[engine]:
        text = re.sub(pattern, repl, text)
    return text


def _needs(text: str, names) -> list[str]:
    words = set(re.findall(r"\b[a-z_][a-z0-9_]*\b", re.sub(r"'[^']*'", " ", text)))
    return [n for n in names if n in words]


def with_views(final: str, views: dict[str, str], engine: str, head: dict[str, str] | None = None) -> str:
    """``final`` preceded by the CTEs it needs, in dependency order."""
    known = {**(head or {}), **views}
    order: list[str] = []

    def visit(text: str, seen: tuple[str, ...]):
        for n in _needs(text, known):
            if n in order or n in seen:
                continue
            visit(known[n], seen + (n,))
            order.append(n)

    visit(final, ())
    recursive = "RECURSIVE " if engine == "duckdb" else ""
    mat = "MATERIALIZED " if engine == "duckdb" else ""
    ctes = ",\n".join(f"{n} AS {mat}({render(known[n], engine)})" for n in order)
    final = render(final, engine).strip()
    if ctes and final.startswith("WITH "):
        return f"WITH {recursive}{ctes},\n{final[5:]}"
    return (f"WITH {recursive}{ctes}\n" if ctes else "") + final
