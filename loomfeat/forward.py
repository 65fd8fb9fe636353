"""Forward passes of the learned blocks as SQL: every number of every step is a column, so that DuckDB can check the kernels."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from loomfeat.operators.neural import Weights

Row = list[str]


class Script:
    """Columns in levels: those of one level are made of columns of the levels before."""

    def __init__(self, inputs: Sequence[str]):
        self.level = {x: 0 for x in inputs}
        self.made: list[list[str]] = []

    def let(self, expression: str, *of: str) -> str:
        at = 1 + max(self.level[x] for x in of)
        while len(self.made) < at:
            self.made.append([])
        name = f"v{len(self.level)}"
        self.level[name] = at
        self.made[at - 1].append(f"{expression} as {name}")
        return name

    def over(self, source: str) -> str:
        for level in self.made:
            source = f"(select *, {', '.join(level)} from {source})"
        return source

    # vectors are lists of columns, a matrix is a list of vectors

    def each(self, form: str, *rows: Row) -> Row:
        return [self.let(form.format(*xs), *xs) for xs in zip(*rows, strict=True)]

    def dense(self, x: Row, w: Weights, name: str, units: int) -> Row:
        m = w(name, len(x), units)
        return [self.let(" + ".join(f"{v} * ({float(m[i, j])!r})" for i, v in enumerate(x)), *x) for j in range(units)]

    def sigmoid(self, x: Row) -> Row:
        return self.each("1 / (1 + exp(-({})))", x)

    def relu(self, x: Row) -> Row:
        return self.each("greatest({}, 0)", x)

    def add(self, x: Row, y: Row) -> Row:
        return self.each("{} + {}", x, y)

    def dot(self, x: Row, y: Row) -> str:
        return self.let(" + ".join(f"{a} * {b}" for a, b in zip(x, y, strict=True)), *x, *y)

    def norm(self, x: Row) -> Row:
        mean = self.let(f"({' + '.join(x)}) / {len(x)}", *x)
        off = [self.let(f"{v} - {mean}", v, mean) for v in x]
        scale = self.let(f"sqrt(({' + '.join(f'{v} * {v}' for v in off)}) / {len(x)} + 1e-6)", *off)
        return [self.let(f"{v} / {scale}", v, scale) for v in off]

    def softmax(self, x: Row) -> Row:
        e = self.each("exp({})", x)
        total = self.let(" + ".join(e), *e)
        return [self.let(f"{v} / {total}", v, total) for v in e]

    def weighted(self, share: Row, rows: list[Row]) -> Row:
        return [self.dot(share, [r[j] for r in rows]) for j in range(len(rows[0]))]


def glu(s: Script, x: Row, w: Weights, units: int, name: str = "glu") -> Row:
    return s.each("{} * {}", s.dense(x, w, f"{name}.a", units), s.sigmoid(s.dense(x, w, f"{name}.b", units)))


def grn(s: Script, x: Row, w: Weights, units: int, name: str = "grn") -> Row:
    h = s.each("case when {0} > 0 then {0} else exp({0}) - 1 end", s.dense(x, w, f"{name}.1", units))
    gate = glu(s, s.dense(h, w, f"{name}.2", units), w, units, f"{name}.glu")
    return s.norm(s.add(x if len(x) == units else s.dense(x, w, f"{name}.skip", units), gate))


def variable_selection(s: Script, x: Row, w: Weights, units: int) -> Row:
    share = s.softmax(grn(s, x, w, len(x), "vsn.w"))
    return share + s.weighted(share, [grn(s, [v], w, units, f"vsn.{i}") for i, v in enumerate(x)])


def attention(s: Script, q: list[Row], kv: list[Row], w: Weights, units: int, heads: int, name: str) -> list[Row]:
    a, k, v = ([s.dense(t, w, f"{name}.{part}", units) for t in rows] for part, rows in (("q", q), ("k", kv), ("v", kv)))
    size, out = units // heads, []
    for x in a:
        joined: Row = []
        for h in range(0, units, size):
            score = s.softmax([s.let(f"{d} / sqrt({size})", d) for d in (s.dot(x[h : h + size], y[h : h + size]) for y in k)])
            joined += s.weighted(score, [y[h : h + size] for y in v])
        out.append(s.dense(joined, w, f"{name}.o", len(q[0])))
    return out


def tokens(s: Script, x: Row, w: Weights, units: int, name: str) -> list[Row]:
    m = w(name, len(x), units)
    return [[s.let(f"{v} * ({float(m[i, j])!r})", v) for j in range(units)] for i, v in enumerate(x)]


def attended(s: Script, q: list[Row], kv: list[Row], w: Weights, units: int, name: str) -> list[Row]:
    return [s.norm(s.add(a, b)) for a, b in zip(q, attention(s, q, kv, w, units, 2, name), strict=True)]


def transformer(s: Script, x: Row, w: Weights, units: int, name: str = "tr", inner: str = "mha") -> Row:
    t = tokens(s, x, w, units, f"{name}.in")
    t = attended(s, t, t, w, units, f"{name}.{inner}")
    return [v for r in t for v in s.norm(s.add(r, s.dense(s.relu(s.dense(r, w, f"{name}.ff1", 2 * units)), w, f"{name}.ff2", units)))]


def multi_resolution(s: Script, x: Row, w: Weights, units: int, numeric: int = 2) -> Row:
    t = tokens(s, x, w, units, "mr.in")
    a, b = t[:numeric], t[numeric:]
    a, b = attended(s, a, a, w, units, "mr.num"), attended(s, b, b, w, units, "mr.cat")
    return [v for r in attended(s, a, b, w, units, "mr.cross") + b for v in r]


def mixture(s: Script, x: Row, w: Weights, units: int, experts: int = 4) -> Row:
    share = s.softmax(s.dense(x, w, "moe.gate", experts))
    return s.weighted(share, [s.relu(s.dense(x, w, f"moe.{e}", units)) for e in range(experts)])


def numerical_embedding(s: Script, x: Row, w: Weights, units: int, bins: int = 10) -> Row:
    gate, table, out = w("ne.gate", 1, units)[0], w("ne.bins", bins, units), []
    for v in x:
        smooth = s.dense(s.relu(s.dense([v], w, "ne.1", units)), w, "ne.2", units)
        at = s.let(f"1 + greatest(0, least({bins - 1}, floor({v} / (1 + 1e-6) * {bins})))::int", v)
        for j in range(units):
            column = "[" + ", ".join(repr(float(y)) for y in table[:, j]) + "]"
            g = f"(1 / (1 + exp(-({float(gate[j])!r}))))"
            out.append(s.let(f"{g} * {smooth[j]} + (1 - {g}) * ({column})[{at}]", smooth[j], at))
    return out


BLOCKS: dict[str, Callable[[Script, Row, Weights, int], Row]] = {
    "glu": glu, "grn": grn, "variable_selection": variable_selection, "transformer": transformer, "tabular_attention": lambda s, x, w, units: transformer(s, x, w, units, "ta", "features"),
    "multi_resolution": multi_resolution, "moe": mixture, "numerical_embedding": numerical_embedding,
}


def sql(keys: str, inputs: dict[str, str], table: str, units: int, digits: int) -> str:
    """Keys and, of each block with the weights of seed 0, its rounded outputs over the inputs (name, expression)."""
    s = Script(list(inputs))
    made = {b: f(s, list(inputs), Weights(0), units) for b, f in BLOCKS.items()}
    base = f"(select {keys}, {', '.join(f'{e} as {n}' for n, e in inputs.items())} from {table})"
    return f"select {keys}, " + ", ".join(f"[{', '.join(f'round({v}, {digits}) + 0.0' for v in out)}] as {b}" for b, out in made.items()) + f" from {s.over(base)}"
