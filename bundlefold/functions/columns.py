"""Expressions over the engine's columns, all built of Spark's own functions."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x: str | Column) -> Column:
    return F.col(x) if isinstance(x, str) else x


def _map(codes: Mapping) -> Column:
    return F.create_map(*[F.lit(x) for pair in codes.items() for x in pair])


def name_of(code: str | Column, codes: Mapping[int, str], what: str) -> Column:
    """The name of an enumeration's code; an unknown code stops the query."""
    c = _c(code).cast("int")
    name = F.try_element_at(_map(codes), c)
    return F.when(c.isNull(), F.lit(None).cast("string")).when(name.isNull(), F.raise_error(F.concat(F.lit(f"unsupported {what}: "), c.cast("string"))).cast("string")).otherwise(name)


def code_of(name: str | Column, codes: Mapping[int, str], what: str) -> Column:
    c = _c(name)
    code = F.try_element_at(_map({v: k for k, v in codes.items()}), c)
    return F.when(c.isNull(), F.lit(None).cast("int")).when(code.isNull(), F.raise_error(F.concat(F.lit(f"unsupported {what}: "), c)).cast("int")).otherwise(code)


def flag_names(bits: str | Column, names: Sequence[str]) -> Column:
    """The names of the bits set, lowest first."""
    b = _c(bits).cast("long")
    return F.filter(F.array(*[F.when(b.bitwiseAND(1 << k) != 0, F.lit(n)) for k, n in enumerate(names)]), lambda x: x.isNotNull())


def octal_mode(mode: str | Column) -> Column:
    return F.concat(F.lit("0o"), F.conv(_c(mode).cast("string"), 10, 8))


def hex_lower(raw: str | Column) -> Column:
    return F.lower(F.hex(_c(raw)))


def lossy_utf8(raw: str | Column) -> Column:
    """Text of bytes, with a replacement character for each malformed sequence."""
    return F.make_valid_utf8(_c(raw).cast("string"))


# -- paths -----------------------------------------------------------------------------------------------------------


def components(path: str | Column) -> Column:
    """A path's segments; the empty path has none."""
    p = _c(path)
    return F.when(p == "", F.array().cast("array<string>")).otherwise(F.split(p, "/"))


def path_error(path: str | Column, strict: bool = False) -> Column:
    """Why a path may not be restored below an output folder, or null: absolute, NUL byte, a '..' segment, or a '.' at
    its beginning. Empty and '.' segments elsewhere don't change where a path leads; strict rejects them too. The empty
    path is the output folder itself."""
    p = _c(path)
    parts = F.split(p, "/")
    rest = F.exists(parts, lambda x: x.isin("", ".")) if strict else F.lit(False)
    return (
        F.when(p.isNull(), F.lit("null path"))
        .when(p == "", F.lit(None).cast("string"))
        .when(p.startswith("/"), F.lit("absolute path"))
        .when(F.instr(p, "\0") > 0, F.lit("NUL byte"))
        .when(F.exists(parts, lambda x: x == ".."), F.lit("parent segment"))
        .when(F.get(parts, 0) == ".", F.lit("current segment"))
        .when(rest, F.lit("idle segment"))
    )


def safe_join(root: str | Column, path: str | Column) -> Column:
    """root/path, or an error that stops the query if the path isn't safe."""
    r, p = F.rtrim(_c(root), F.lit("/")) if not isinstance(root, str) else F.lit(root.rstrip("/")), _c(path)
    error = path_error(p)
    return F.when(error.isNotNull(), F.raise_error(F.concat(F.lit("unsafe path: "), error)).cast("string")).when(p == "", r).otherwise(F.concat(r, F.lit("/"), p))


def parent_of(path: str | Column) -> Column:
    """Everything before the last segment; null for the empty path."""
    p = _c(path)
    parts = components(p)
    return F.when(p == "", F.lit(None).cast("string")).otherwise(F.array_join(F.slice(parts, 1, F.size(parts) - 1), "/"))


def leaf_of(path: str | Column) -> Column:
    return F.try_element_at(components(path), F.lit(-1))


# -- names and templates ---------------------------------------------------------------------------------------------


def safe_name(name: str | Column) -> Column:
    return F.translate(F.replace(_c(name), F.lit("@"), F.lit("")), "/.", "--")


def render(template: str | Column, values: Mapping[str, Column]) -> Column:
    """A template with each {{KEY}} replaced, one key after the other."""
    out = _c(template)
    for key, value in values.items():
        out = F.replace(out, F.lit("{{" + key + "}}"), value)
    return out


def lines(items: str | Column, one, joint: str = "\n", last: str = "") -> Column:
    """Items written out by one(item, index) and joined; `last` is what each but the last is followed by."""
    a = _c(items)
    return F.array_join(F.transform(a, lambda x, i: F.concat(one(x, i), F.when(i + 1 == F.size(a), F.lit("")).otherwise(F.lit(last)))), joint)


def shell_word(word: str | Column) -> Column:
    """A word as a POSIX shell reads it back."""
    w = _c(word)
    return F.when(w.rlike(r"\A[A-Za-z0-9/._:-]+\z"), w).otherwise(F.concat(F.lit("'"), F.replace(w, F.lit("'"), F.lit("'\"'\"'")), F.lit("'")))


# -- statistics ------------------------------------------------------------------------------------------------------


def measured(value: str | Column) -> Column:
    return F.struct(F.lit("measured").alias("status"), _c(value).cast("long").alias("value"), F.lit(None).cast("string").alias("note"))


def unavailable(note: str) -> Column:
    return F.struct(F.lit("unavailable").alias("status"), F.lit(None).cast("long").alias("value"), F.lit(note).alias("note"))


def wall_buckets(total: str | Column, setup: str | Column, pipeline: str | Column) -> dict[str, Column]:
    """setup, pipeline and finalize milliseconds that add up to the total: the first two clamped in turn, the last the rest."""
    t, s, p = _c(total), _c(setup), _c(pipeline)
    a = F.least(s, t)
    b = F.least(p, t - a)
    return {"setup_ms": a, "pipeline_ms": b, "finalize_ms": t - a - b}


def per_second(amount: str | Column, ms: str | Column, otherwise: float | None = 0.0) -> Column:
    """amount a second; `otherwise` where no time has passed."""
    m = _c(ms)
    return F.when(m > 0, _c(amount) / (m / F.lit(1000.0))).otherwise(F.lit(otherwise).cast("double"))


def mib(amount: str | Column) -> Column:
    return _c(amount) / F.lit(float(1 << 20))


def estimated_bundles(raw: str | Column, target: int) -> Column:
    r = _c(raw)
    return F.when(r > 0, F.ceil(r / F.lit(max(1, target)))).otherwise(F.lit(0)).cast("long")


#: The share of the raw size that a codec is expected to leave.
EXPECTED_SHARE = {"lz4": 0.72, "zstd": 0.58, "none": 1.0}


def estimated_encoded(raw: str | Column, codec: str) -> Column:
    return (_c(raw) * F.lit(EXPECTED_SHARE[codec])).cast("long")


def saturating_sum(value: str | Column) -> Column:
    """A sum that stops at the largest long."""
    return F.coalesce(F.try_sum(_c(value)), F.lit((1 << 63) - 1))
