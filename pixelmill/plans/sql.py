"""SQL for DuckDB that says what the queries compute, for comparison. Sums of doubles keep the order of the taps."""

from __future__ import annotations

from collections.abc import Sequence

from ..functions import filters as K
from ..functions.config import FeatureConfig, feature_names

EMB = """px AS (
  SELECT 0 AS img, vec_id::INT AS y, (pos - 1)::INT AS x, floor((e::DOUBLE + 1.0::DOUBLE) * 127.5::DOUBLE)::INT AS b,
         floor((e::DOUBLE + 1.0::DOUBLE) * 127.5::DOUBLE)::INT / 255.0::DOUBLE AS v
  FROM (SELECT vec_id, unnest(embedding) AS e, generate_subscripts(embedding, 1) AS pos FROM embeddings))"""
CLS = """classes AS (
  SELECT 0 AS img, vec_id::INT AS y, (pos - 1)::INT AS x, (label % 3)::INT AS cls
  FROM (SELECT vec_id, label, generate_subscripts(embedding, 1) AS pos FROM embeddings))"""
LABELS = "labels AS (SELECT img, y, x, CASE WHEN y % 5 = 0 THEN cls + 1 ELSE 0 END AS label FROM classes)"
EVT = """counts AS (SELECT event_type AS img, day(ts) - 1 AS y, hour(ts) AS x, count(*)::INT AS n FROM events GROUP BY ALL),
px AS (
  SELECT t.img, gy.y::INT AS y, gx.x::INT AS x, coalesce(n, 0)::INT AS b, coalesce(n, 0) / 255.0::DOUBLE AS v
  FROM (SELECT DISTINCT event_type AS img FROM events) t, range(31) gy(y), range(24) gx(x) LEFT JOIN counts c ON c.img = t.img AND c.y = gy.y AND c.x = gx.x)"""
PROB = "prob AS (SELECT *, [b / 383.0::DOUBLE, (255 - b) / 383.0::DOUBLE, 128 / 383.0::DOUBLE] AS prob FROM px)"
SEG = "seg AS (SELECT img, y, x, (list_position(prob, list_max(prob)) - 1)::INT AS seg FROM prob)"


def d(x: float) -> str:
    return f"CAST('{x!r}' AS DOUBLE)"


def query(*ctes: str, select: str, recursive: bool = False) -> str:
    return f"WITH {'RECURSIVE ' if recursive else ''}{', '.join(ctes)}\n{select}"


_AXIS = {"y": "PARTITION BY img, x ORDER BY y", "x": "PARTITION BY img, y ORDER BY x"}
_ALL = "ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING"


def near(col: str, k: int, axis: str, mode: str = "nearest") -> str:
    if k == 0:
        return col
    shift = f"{'lag' if k < 0 else 'lead'}({col}, {abs(k)}) OVER ({_AXIS[axis]})"
    if mode == "none":
        return shift
    if mode == "zero":
        return f"coalesce({shift}, 0.0::DOUBLE)"
    if mode == "mirror1":  # reach of one pixel, mirrored about the border pixel
        return f"coalesce({shift}, {'lead' if k < 0 else 'lag'}({col}, 1) OVER ({_AXIS[axis]}))"
    end = "first_value" if k < 0 else "last_value"
    return f"coalesce({shift}, {end}({col}) OVER ({_AXIS[axis]} {_ALL}))"


def blur(source: str, col: str, taps: Sequence[float], name: str, out: str, mode: str = "nearest") -> list[str]:
    """CTE ``name``: source with a column ``out``."""
    r = len(taps) // 2
    if r == 0:
        return [f"{name} AS (SELECT *, {col} AS {out} FROM {source})"]
    sums = lambda c, axis: " + ".join(f"{d(w)} * {near(c, k - r, axis, mode)}" for k, w in enumerate(taps))
    return [f"{name}_y AS (SELECT *, {sums(col, 'y')} AS t_{out} FROM {source})", f"{name} AS (SELECT * EXCLUDE (t_{out}), {sums(f't_{out}', 'x')} AS {out} FROM {name}_y)"]


def grad(col: str, axis: str) -> str:
    a, b = near(col, -1, axis, "none"), near(col, 1, axis, "none")
    return f"CASE WHEN {a} IS NULL AND {b} IS NULL THEN 0.0::DOUBLE WHEN {a} IS NULL THEN {b} - {col} WHEN {b} IS NULL THEN {col} - {a} ELSE ({b} - {a}) / 2.0::DOUBLE END"


def eigen(a: str, b: str, e: str, names: Sequence[str]) -> str:
    root = f"sqrt(4 * {b} * {b} + ({a} - {e}) * ({a} - {e}))"
    made = [f"({a} + {e} + {root}) / 2", f"({a} + {e} - {root}) / 2", f"sqrt({a} * {a} + {b} * {b} + {e} * {e})", f"{a} + {e}", f"{a} * {e} - {b} * {b}"]
    return ", ".join(f"{m} AS {n}" for m, n in zip(made, names))


def derived(source: str, col: str, name: str, edges: str, hess: Sequence[str]) -> list[str]:
    """CTE ``name``: source with the edge column and Hessian columns of ``col``."""
    return [
        f"{name}_1 AS (SELECT *, {grad(col, 'x')} AS gx_, {grad(col, 'y')} AS gy_ FROM {source})",
        f"{name}_2 AS (SELECT *, {grad('gx_', 'x')} AS d_, {grad('gy_', 'x')} AS b_, {grad('gy_', 'y')} AS a_ FROM {name}_1)",
        f"{name} AS (SELECT * EXCLUDE (gx_, gy_, a_, b_, d_), sqrt(gx_ * gx_ + gy_ * gy_) AS {edges}, {eigen('a_', 'b_', 'd_', hess)} FROM {name}_2)",
    ]


def offsets(cells: Sequence[tuple[int, int]]) -> str:
    return f"offs(dy, dx) AS (VALUES {', '.join(f'({y}, {x})' for y, x in cells)})"


def spots(name: str = "spots", offs: str = "offs") -> str:
    """Every pixel with the places of its neighbourhood, to be joined by equality."""
    return f"{name} AS (SELECT p.img, p.y, p.x, p.b, p.y + o.dy AS qy, p.x + o.dx AS qx FROM px p, {offs} o)"


def over_disc(cells, aggregate: str) -> list[str]:
    return [offsets(cells), spots(), f"out AS (SELECT p.img, p.y, p.x, {aggregate} FROM spots p JOIN px q ON q.img = p.img AND q.y = p.qy AND q.x = p.qx GROUP BY p.img, p.y, p.x)"]


def rank(radius: int, kind: str) -> str:
    made = {"mean": "(sum(q.b) // count(*))::BIGINT", "minimum": "min(q.b)::BIGINT", "maximum": "max(q.b)::BIGINT", "median": "list_sort(list(q.b))[count(*) // 2 + 1]::BIGINT"}[kind]
    return query(EMB, *over_disc(K.disc(radius), f"{made} AS {kind}"), select="SELECT * FROM out")


def bilateral(radii, widths) -> str:
    names = [(r, w) for r in radii for w in widths]
    ctes = [EMB]
    for r, w in names:
        ctes.append(f"o{r}_{w}(dy, dx) AS (VALUES {', '.join(map(str, K.disc(r)))})")
        ctes.append(spots(f"s{r}_{w}", f"o{r}_{w}"))
        ctes.append(
            f"t{r}_{w} AS (SELECT p.img, p.y, p.x, (sum(q.b) // count(*))::BIGINT AS bilateral_r{r}_v{w} FROM s{r}_{w} p JOIN px q ON q.img = p.img AND q.y = p.qy "
            f"AND q.x = p.qx WHERE abs(q.b - p.b) < {w} GROUP BY p.img, p.y, p.x)"
        )
    first, *rest = [f"t{r}_{w}" for r, w in names]
    return query(*ctes, select=f"SELECT * FROM {first} " + " ".join(f"JOIN {t} USING (img, y, x)" for t in rest))


def membrane(patch: int, mode: str = "reflect", ddof: int = 0, middle: bool = True) -> list[str]:
    """CTE ``membrane``: the six projections. Whole-number sums, so their order is free."""
    cells = [(k, dy, dx, w) for k, kernel in enumerate(K.membrane_kernels(patch)) for dy, dx, w in kernel]

    def mirror(i: str, n: str) -> str:
        if mode == "reflect":
            return f"CASE WHEN {i} < 0 THEN -({i}) - 1 WHEN {i} >= {n} THEN 2 * {n} - 1 - ({i}) ELSE {i} END"
        return f"CASE WHEN abs({i}) >= {n} THEN 2 * ({n} - 1) - abs({i}) ELSE abs({i}) END"

    med = "(list_sort(list(s))[15] + list_sort(list(s))[16]) / 2.0::DOUBLE / 255.0::DOUBLE" if middle else "list_sort(list(s))[15]::DOUBLE / 255.0::DOUBLE"
    return [
        f"taps(k, dy, dx, w) AS (VALUES {', '.join(map(str, cells))})",
        "size AS (SELECT img, max(y) + 1 AS h, max(x) + 1 AS wd FROM px GROUP BY img)",
        f"spots AS (SELECT p.img, p.y, p.x, t.k, t.w, {mirror('p.y + t.dy', 'z.h')} AS qy, {mirror('p.x + t.dx', 'z.wd')} AS qx FROM px p JOIN size z USING (img), taps t)",
        "resp AS (SELECT s.img, s.y, s.x, k, sum(w * q.b)::BIGINT AS s FROM spots s JOIN px q ON q.img = s.img AND q.y = s.qy AND q.x = s.qx GROUP BY ALL)",
        "membrane AS (SELECT img, y, x, sum(s)::BIGINT / 255.0::DOUBLE / 30.0::DOUBLE AS membrane_mean, max(s) / 255.0::DOUBLE AS membrane_max, min(s) / 255.0::DOUBLE AS membrane_min, "
        f"sum(s)::BIGINT / 255.0::DOUBLE AS membrane_sum, sqrt((30 * sum(s * s)::BIGINT - sum(s)::BIGINT * sum(s)::BIGINT) / {float(30 * (30 - ddof))}::DOUBLE) / 255.0::DOUBLE AS membrane_std, {med} AS membrane_median "
        "FROM resp GROUP BY img, y, x)",
    ]


def multiscale(config: FeatureConfig | None = None) -> str:
    """The stack of the default filters (blur, edges, Hessian, differences, membrane)."""
    c = config or FeatureConfig()
    names = feature_names(c)
    ctes = [EMB, *derived("px", "v", "z", "e0", [f"h0_{i}" for i in range(5)])]
    source, columns, blurs = "z", ["v", "e0", *[f"h0_{i}" for i in range(5)]], []
    done: dict[tuple, str] = {(1.0,): "0"}
    for k, s in enumerate(c.sigmas):
        taps = K.gaussian_taps(s, c.multiplier)
        if taps not in done:
            done[taps] = str(k + 1)
            ctes += blur(source, "v", taps, f"g{k}_", f"g{k + 1}")
            ctes += derived(f"g{k}_", f"g{k + 1}", f"f{k}_", f"e{k + 1}", [f"h{k + 1}_{i}" for i in range(5)])
            source = f"f{k}_"
        i = done[taps]
        g = "v" if i == "0" else f"g{i}"
        blurs.append(g)
        columns += [g, f"e{i}", *[f"h{i}_{j}" for j in range(5)]]
    columns += [f"{blurs[j]} - {blurs[i]}" for i in range(len(blurs)) for j in range(i)]
    ctes += membrane(c.membrane_patch_size)
    columns += [f"membrane_{m}" for m in ("mean", "max", "min", "sum", "std", "median")]
    made = ", ".join(f"{e} AS {n}" for e, n in zip(columns, names, strict=True))
    return query(*ctes, select=f"SELECT img, y, x, {made} FROM {source} JOIN membrane USING (img, y, x)")


def shifted(col: str, dy: int, dx: int, rows: dict[int, str], mode: str) -> str:
    return near(rows[dy], dx, "x", mode) if dx else rows[dy]


def kernel3(source: str, col: str, kernel, name: str, out: str, mode: str, divide: str = "") -> list[str]:
    """CTE ``name``: source with a 3 x 3 correlation, terms row by row."""
    terms = []
    for y in (-1, 0, 1):
        for x in (-1, 0, 1):
            w = kernel[y + 1][x + 1]
            if w:
                base = {-1: "up_", 0: col, 1: "dn_"}[y]
                terms.append(f"{near(base, x, 'x', mode)} * {float(w)}::DOUBLE")
    return [
        f"{name}_r AS (SELECT *, {near(col, -1, 'y', mode)} AS up_, {near(col, 1, 'y', mode)} AS dn_ FROM {source})",
        f"{name} AS (SELECT * EXCLUDE (up_, dn_), ({' + '.join(terms)}){divide} AS {out} FROM {name}_r)",
    ]


SOBEL_Y = tuple(zip(*K.SOBEL_X))


def structure(sigma: float) -> str:
    taps = K.normal_taps(sigma, int(4 * sigma + 0.5))
    ctes = [EMB, *kernel3("px", "v", SOBEL_Y, "s1", "gy", "zero"), *kernel3("s1", "v", K.SOBEL_X, "s2", "gx", "zero"), "s3 AS (SELECT *, gy * gy AS yy, gy * gx AS yx, gx * gx AS xx FROM s2)"]
    ctes += blur("s3", "yy", taps, "b1", "a_", "zero") + blur("b1", "yx", taps, "b2", "b_", "zero") + blur("b2", "xx", taps, "b3", "d_", "zero")
    return query(*ctes, select=f"SELECT img, y, x, {eigen('a_', 'b_', 'd_', ['structure_eig_1', 'structure_eig_2'])} FROM b3")


def square(radius: int) -> str:
    n = (2 * radius + 1) ** 2
    fold = lambda i, m: f"CASE WHEN abs({i}) >= {m} THEN 2 * ({m} - 1) - abs({i}) ELSE abs({i}) END"
    return query(
        EMB, "size AS (SELECT img, max(y) + 1 AS h, max(x) + 1 AS w FROM px GROUP BY img)",
        f"spots AS (SELECT p.img, p.y, p.x, {fold('p.y + dy', 'z.h')} AS qy, {fold('p.x + dx', 'z.w')} AS qx FROM px p JOIN size z USING (img), range({-radius}, {radius + 1}) a(dy), range({-radius}, {radius + 1}) c(dx))",
        select=f"SELECT s.img, s.y, s.x, sum(q.b)::BIGINT / {float(n)}::DOUBLE AS mean, min(q.b)::BIGINT AS minimum, max(q.b)::BIGINT AS maximum FROM spots s JOIN px q ON q.img = s.img AND q.y = s.qy AND q.x = s.qx GROUP BY ALL",
    )


def square_median(radius: int) -> str:
    n = (2 * radius + 1) ** 2
    return query(
        EMB, f"spots AS (SELECT p.img, p.y, p.x, p.y + dy AS qy, p.x + dx AS qx FROM px p, range({-radius}, {radius + 1}) a(dy), range({-radius}, {radius + 1}) c(dx))",
        select=f"SELECT s.img, s.y, s.x, list_sort(list(coalesce(q.b, 0)))[{(n - 1) // 2 + 1}]::BIGINT AS median FROM spots s LEFT JOIN px q ON q.img = s.img AND q.y = s.qy AND q.x = s.qx GROUP BY ALL",
    )


def gpu_sobel() -> str:
    ctes = [EMB, *kernel3("px", "v", K.SOBEL_X, "s1", "gx", "mirror1", " / 8.0::DOUBLE"), *kernel3("s1", "v", SOBEL_Y, "s2", "gy", "mirror1", " / 8.0::DOUBLE")]
    ctes += kernel3("s2", "gx", K.SOBEL_X, "s3", "a_", "mirror1", " / 8.0::DOUBLE") + kernel3("s3", "gx", SOBEL_Y, "s4", "b_", "mirror1", " / 8.0::DOUBLE") + kernel3("s4", "gy", SOBEL_Y, "s5", "d_", "mirror1", " / 8.0::DOUBLE")
    return query(*ctes, select=f"SELECT img, y, x, sqrt(gx * gx + gy * gy) AS sobel_filter, {eigen('a_', 'b_', 'd_', ['hess_eig_1', 'hess_eig_2', 'hess_mod', 'hess_trace', 'hess_det'])} FROM s5")


def wide(source: str, col: str, taps: Sequence[float], name: str, out: str) -> list[str]:
    """CTE ``name``: (img, y, x, out), a separable sum mirrored about the border pixels, by joins as its reach is wide."""
    r = len(taps) // 2
    fold = lambda i, m: f"CASE WHEN abs({i}) >= {m} THEN 2 * ({m} - 1) - abs({i}) ELSE abs({i}) END"
    step = lambda src, c, axis, other, size, to, o: (
        f"{to} AS (SELECT p.img, p.y, p.x, sum(p.w * q.{c}) AS {o} FROM (SELECT a.img, a.y, a.x, t.w, {fold(f'a.{axis} + t.k', f'z.{size}')} AS at FROM {src} a JOIN {name}_z z USING (img), {name}_t t) p "
        f"JOIN {src} q ON q.img = p.img AND q.{other} = p.{other} AND q.{axis} = p.at GROUP BY ALL)"
    )
    return [
        f"{name}_t(k, w) AS (VALUES {', '.join(f'({k - r}, {d(w)})' for k, w in enumerate(taps))})", f"{name}_z AS (SELECT img, max(y) + 1 AS h, max(x) + 1 AS wd FROM {source} GROUP BY img)",
        step(source, col, "y", "x", "h", f"{name}_y", f"y_{out}"), step(f"{name}_y", f"y_{out}", "x", "y", "wd", name, out),
    ]


def near_zero(expression: str) -> str:
    """Rounded, and never a negative zero."""
    return f"round({expression}, 6) + 0.0::DOUBLE"


def soft_bilateral(radii: Sequence[int], widths: Sequence[float]) -> str:
    """Weighted means of square windows, weights by distance and by difference from the centre."""
    fold = lambda i, m: f"CASE WHEN abs({i}) >= {m} THEN 2 * ({m} - 1) - abs({i}) ELSE abs({i}) END"
    ctes, made = [EMB, "size AS (SELECT img, max(y) + 1 AS h, max(x) + 1 AS w FROM px GROUP BY img)"], []
    for r in radii:
        g = K.normal_taps(0.3 * ((2 * r + 1 - 1) * 0.5 - 1) + 0.8, r)
        ctes.append(f"g{r}(k, w) AS (VALUES {', '.join(f'({k - r}, {d(w)})' for k, w in enumerate(g))})")
        ctes.append(f"s{r} AS (SELECT p.img, p.y, p.x, p.v, a.w * c.w AS g, {fold('p.y + a.k', 'z.h')} AS qy, {fold('p.x + c.k', 'z.w')} AS qx FROM px p JOIN size z USING (img), g{r} a, g{r} c)")
        for width in widths:
            s = width / 255.0
            k = f"s.g * exp(-((q.v - s.v) * (q.v - s.v)) / {d(2 * s * s)})"
            ctes.append(f"t{r}_{width:g} AS (SELECT s.img, s.y, s.x, {near_zero(f'sum({k} * q.v) / sum({k})')} AS bilateral_r{r}_v{width:g} FROM s{r} s JOIN px q ON q.img = s.img AND q.y = s.qy AND q.x = s.qx GROUP BY s.img, s.y, s.x)")
            made.append(f"t{r}_{width:g}")
    return query(*ctes, select=f"SELECT * FROM {made[0]} " + " ".join(f"JOIN {t} USING (img, y, x)" for t in made[1:]))


def gpu_multiscale(config: FeatureConfig, patch: int) -> str:
    """The default stack by the formulas of the accelerated variant."""
    names, ctes, columns = feature_names(config), [EMB], []
    for i, s in enumerate([None, *config.sigmas]):
        source, g = "px", "v"
        if s is not None:
            ctes += wide("px", "v", K.normal_taps(config.multiplier * s, 2 * int(config.multiplier * max(config.sigmas))), f"w{i}", "g")
            source, g = f"w{i}", "g"
        chain = [(source, g, K.SOBEL_X, "gx"), (f"k{i}_0", g, SOBEL_Y, "gy"), (f"k{i}_1", "gx", K.SOBEL_X, "a_"), (f"k{i}_2", "gx", SOBEL_Y, "b_"), (f"k{i}_3", "gy", SOBEL_Y, "d_")]
        for j, (src, col, kernel, out) in enumerate(chain):
            ctes += kernel3(src, col, kernel, f"k{i}_{j}", out, "mirror1", " / 8.0::DOUBLE")
        ctes.append(f"f{i} AS (SELECT img, y, x, {g} AS g{i}, sqrt(gx * gx + gy * gy) AS e{i}, {eigen('a_', 'b_', 'd_', [f'h{i}_{k}' for k in range(5)])} FROM k{i}_4)")
        columns += [f"g{i}", f"e{i}", *[f"h{i}_{k}" for k in range(5)]]
    n = len(config.sigmas)
    columns += [f"g{j + 1} - g{i + 1}" for i in range(n) for j in range(i)]
    ctes += membrane(patch, "mirror", 1, False)
    columns += [f"membrane_{m}" for m in ("mean", "max", "min", "sum", "std", "median")]
    made = ", ".join(f"{near_zero(c)} AS {name}" for c, name in zip(columns, names, strict=True))
    return query(*ctes, select=f"SELECT img, y, x, {made} FROM " + " JOIN ".join([f"f{i}" + (" USING (img, y, x)" if i else "") for i in range(n + 1)]) + " JOIN membrane USING (img, y, x)")


MASK = "mask AS (SELECT img, y, x, b >= 4 AS m FROM px)"


def components(source: str, same: str = "") -> list[str]:
    """CTE ``comp``: source's pixels with lab, the first pixel of their component as y * 2**20 + x. ``same``: a column that neighbours share."""
    also = f" AND n.{same} = r.{same}" if same else ""
    keep = f", {same}" if same else ""
    return [
        f"reach AS (SELECT img, y, x, y AS ry, x AS rx{keep} FROM {source} UNION SELECT n.img, n.y, n.x, r.ry, r.rx{', n.' + same if same else ''} FROM reach r JOIN {source} n ON n.img = r.img AND abs(n.y - r.y) <= 1 AND abs(n.x - r.x) <= 1{also})",
        f"comp AS (SELECT img, y, x{keep}, min(ry::BIGINT * 1048576 + rx) AS lab FROM reach GROUP BY ALL)",
    ]


def edt(source: str = "mask", inside: str = "m", name: str = "edt") -> str:
    return f"{name} AS (SELECT p.img, p.y, p.x, min((p.y - q.y) * (p.y - q.y) + (p.x - q.x) * (p.x - q.x))::BIGINT AS d2 FROM {source} p LEFT JOIN (SELECT * FROM {source} WHERE NOT ({inside})) q ON q.img = p.img GROUP BY ALL)"


def objective(target: str, weight: float = 1.0) -> list[str]:
    """CTE ``obj`` from ``mask``: loss and gradient of one target, not rounded."""
    ctes = ["on_ AS (SELECT * FROM mask WHERE m)", *components("on_"), "reg AS (SELECT img, lab, count(*) AS area FROM comp GROUP BY ALL)", "n AS (SELECT img, count(*) AS n, max(area) AS largest FROM reg GROUP BY img)", "same AS (SELECT img, bool_and(m) OR NOT bool_or(m) AS u FROM mask GROUP BY img)"]
    w = d(weight)
    if target == "minimise":
        ctes.append(edt())
        loss = f"CASE WHEN u OR n.n IS NULL THEN 0.0::DOUBLE ELSE {w} / n.n END"
        g = f"{w} * ({loss}) * CASE WHEN coalesce(e.d2, 0) > 0 THEN 1.0::DOUBLE / sqrt(e.d2::DOUBLE) ELSE 0.0::DOUBLE END"
    else:
        ctes += ["turned AS (SELECT img, y, x, NOT m AS m FROM mask)", edt("turned")]
        loss = f"CASE WHEN u OR n.n IS NULL THEN 0.0::DOUBLE ELSE {w} * ln(n.n::DOUBLE) END"
        g = f"{w} * ({loss}) * (coalesce(reg.area / n.largest::DOUBLE, 0.0::DOUBLE) + CASE WHEN coalesce(e.d2, 0) > 0 THEN 1.0::DOUBLE / sqrt(e.d2::DOUBLE) ELSE 0.0::DOUBLE END)"
    ctes.append(
        f"obj AS (SELECT k.img, k.y, k.x, {loss} AS loss, {g} AS grad FROM mask k JOIN same USING (img) LEFT JOIN n ON n.img = k.img JOIN edt e ON e.img = k.img AND e.y = k.y AND e.x = k.x "
        "LEFT JOIN comp c ON c.img = k.img AND c.y = k.y AND c.x = k.x LEFT JOIN reg ON reg.img = c.img AND reg.lab = c.lab)"
    )
    return ctes


def equalized(source: str = "px", name: str = "flat", clip: float = 0.01) -> list[str]:
    """CTE ``name``: adaptive equalisation on a grid of 8 x 8 tiles with 256 bins."""
    near = lambda i, j, k: f"LEFT JOIN shares {k} ON {k}.img = p.img AND {k}.i = {i} AND {k}.j = {j} AND {k}.q = p.q"
    return [
        f"sides AS (SELECT img, greatest(1, ceil((max(y) + 1) / 8.0))::INT AS th, greatest(1, ceil((max(x) + 1) / 8.0))::INT AS tw, max(y) + 1 AS h, max(x) + 1 AS w, min(v) AS lo, max(v) AS hi FROM {source} GROUP BY img)",
        "grid AS (SELECT *, ceil(h::DOUBLE / th)::INT AS ny, ceil(w::DOUBLE / tw)::INT AS nx FROM sides)",
        f"placed AS (SELECT p.*, g.* EXCLUDE (img), CASE WHEN hi <= lo THEN 0 ELSE least(floor((v - lo) / (hi - lo) * 256), 255)::INT END AS q, (y + 0.5::DOUBLE) / th - 0.5 AS fy, (x + 0.5::DOUBLE) / tw - 0.5 AS fx FROM {source} p JOIN grid g USING (img))",
        "bins AS (SELECT img, y // th AS i, x // tw AS j, q, count(*) AS n FROM placed GROUP BY ALL)",
        "tiles AS (SELECT img, i, j, sum(n)::DOUBLE AS size FROM bins GROUP BY ALL)",
        f"cut AS (SELECT t.img, t.i, t.j, t.size, r.q::INT AS q, least(coalesce(b.n, 0)::DOUBLE, greatest(1.0::DOUBLE, {clip} * t.size)) AS n, greatest(coalesce(b.n, 0) - greatest(1.0::DOUBLE, {clip} * t.size), 0.0::DOUBLE) AS over FROM tiles t CROSS JOIN range(256) r(q) LEFT JOIN bins b ON b.img = t.img AND b.i = t.i AND b.j = t.j AND b.q = r.q)",
        "shares AS (SELECT img, i, j, q, (sum(n) OVER (PARTITION BY img, i, j ORDER BY q) + (q + 1) * (sum(over) OVER (PARTITION BY img, i, j)) / 256) / size AS s FROM cut)",
        "around AS (SELECT *, greatest(least(floor(fy), ny - 1), 0)::INT AS i0, greatest(least(floor(fx), nx - 1), 0)::INT AS j0 FROM placed)",
        "ends AS (SELECT *, least(i0 + 1, ny - 1) AS i1, least(j0 + 1, nx - 1) AS j1, least(greatest(fy - i0, 0.0::DOUBLE), 1.0::DOUBLE) AS ay, least(greatest(fx - j0, 0.0::DOUBLE), 1.0::DOUBLE) AS ax FROM around)",
        f"{name} AS (SELECT p.img, p.y, p.x, CASE WHEN hi <= lo THEN 0.0::DOUBLE ELSE (1 - ay) * ((1 - ax) * a.s + ax * b.s) + ay * ((1 - ax) * c.s + ax * d.s) END AS v FROM ends p {near('p.i0', 'p.j0', 'a')} {near('p.i0', 'p.j1', 'b')} {near('p.i1', 'p.j0', 'c')} {near('p.i1', 'p.j1', 'd')})",
    ]


def denoised(source: str, levels: int, name: str = "clean") -> list[str]:
    """CTE ``name``: Haar shrinkage of (img, y, x, v); images need at most ``levels`` levels."""
    ctes = [
        f"sizes AS (SELECT img, max(y) + 1 AS h, max(x) + 1 AS w, CASE WHEN least(max(y), max(x)) < 1 THEN 0 ELSE greatest(1, length(bin(least(max(y), max(x)) + 1)) - 4) END AS levels FROM {source} GROUP BY img)",
        f"haar0 AS (SELECT s.img, y, x, v, h, w, levels FROM {source} s JOIN sizes USING (img))",
    ]
    at = lambda dy, dx: f"max(CASE WHEN y % 2 = {dy} AND x % 2 = {dx} THEN v END)"
    for k in range(1, levels + 1):
        ctes += [
            f"block{k} AS (SELECT img, h, w, levels, y // 2 AS y, x // 2 AS x, {at(0, 0)} AS p, {at(0, 1)} AS q, {at(1, 0)} AS r, {at(1, 1)} AS s FROM haar{k - 1} WHERE levels >= {k} GROUP BY img, h, w, levels, y // 2, x // 2)",
            f"whole{k} AS (SELECT img, levels, y, x, (h + 1) // 2 AS h, (w + 1) // 2 AS w, p, coalesce(q, p) AS q, coalesce(r, p) AS r, coalesce(s, q, r, p) AS s FROM block{k})",
            f"haar{k} AS (SELECT img, levels, y, x, h, w, (p + q + r + s) / 2 AS v, (p - q + r - s) / 2 AS dx, (p + q - r - s) / 2 AS dy, (p - q - r + s) / 2 AS dd FROM whole{k})",
        ]
    ctes.append("noise AS (SELECT img, median(abs(dd)) / 0.6744897501960817::DOUBLE AS noise FROM haar1 GROUP BY img)")
    below = None
    for k in range(levels, 0, -1):
        soft = lambda b: f"sign(h.{b}) * greatest(abs(h.{b}) - noise * noise / sqrt(greatest(m_{b} - noise * noise, 1e-12::DOUBLE)), 0.0::DOUBLE) AS {b}"
        mean = "h.v" if below is None else f"CASE WHEN h.levels = {k} THEN h.v ELSE u.v END"
        up = "" if below is None else f"LEFT JOIN {below} u ON u.img = h.img AND u.y = h.y AND u.x = h.x"
        ctes += [
            f"spread{k} AS (SELECT img, avg(dx * dx) AS m_dx, avg(dy * dy) AS m_dy, avg(dd * dd) AS m_dd FROM haar{k} GROUP BY img)",
            f"parent{k} AS (SELECT h.img, h.y, h.x, {mean} AS a, {soft('dx')}, {soft('dy')}, {soft('dd')} FROM haar{k} h JOIN spread{k} USING (img) JOIN noise USING (img) {up})",
            f"up{k} AS (SELECT c.img, c.y, c.x, (a + (CASE WHEN c.x % 2 = 0 THEN 1 ELSE -1 END) * t.dx + (CASE WHEN c.y % 2 = 0 THEN 1 ELSE -1 END) * t.dy + (CASE WHEN (c.x + c.y) % 2 = 0 THEN 1 ELSE -1 END) * t.dd) / 2 AS v FROM haar{k - 1} c JOIN parent{k} t ON t.img = c.img AND t.y = c.y // 2 AND t.x = c.x // 2)",
        ]
        below = f"up{k}"
    ctes.append(f"{name} AS (SELECT * FROM {below} UNION ALL SELECT img, y, x, v FROM haar0 WHERE levels = 0)")
    return ctes
