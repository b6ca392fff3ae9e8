"""Scalar functions as native expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words of a module's path that make it load-bearing by itself.
LOAD_BEARING_WORDS = ["core", "platform", "base", "shared", "common", "infra", "lib", "utils", "foundation", "primitives", "runtime", "framework", "kernel"]


def dirname(path: Column) -> Column:
    """Folder of a path: null for null or '', '.' without a slash, '/' for what lies at the root; slashes at its end are left out."""
    folder = F.regexp_extract(path, "^(.*?)/+[^/]*$", 1)
    return F.when(path.isNull() | (path == ""), None).when(~path.contains("/"), ".").when(folder == "", "/").otherwise(folder)


def dirdir(path: Column) -> Column:
    """The folder of a path as grandparent/parent, one slash between the two; as ``dirname`` where there is no grandparent."""
    return F.regexp_replace(dirname(path), "/+([^/]+)$", "/$1")


def symbol(module: Column, name: Column) -> Column:
    return F.concat(module, F.lit("::"), name)


def rollup_module(module: Column, depth: int) -> Column:
    """First ``depth`` parts of a module; '__unknown__' for null or '', names in double underscores stay."""
    m = F.coalesce(module, F.lit(""))
    return F.when(m == "", "__unknown__").when(m.startswith("__"), m).otherwise(F.array_join(F.slice(F.split(F.regexp_replace(m, "/", "."), r"\."), 1, depth), "."))


def module_depth(module: Column) -> Column:
    """Number of parts of a module; null for null and for names in double underscores, which have none to show."""
    return F.when(~module.startswith("__"), F.size(F.split(F.regexp_replace(module, "/", "."), r"\.")))


def has_load_bearing_word(module: Column) -> Column:
    parts = F.split(F.translate(F.lower(F.coalesce(module, F.lit(""))), ".-", "//"), "/")
    return F.arrays_overlap(parts, F.array(*[F.lit(w) for w in LOAD_BEARING_WORDS]))


def project_and_ref(repo_id: Column) -> tuple[Column, Column]:
    parts = F.split(repo_id, "@", 2)
    return parts[0], F.get(parts, 1)


def instability(ca: Column, ce: Column, isolated: float) -> Column:
    return F.when(ca + ce > 0, ce / (ca + ce)).otherwise(F.lit(isolated))


def middleman(complexity: Column, callers: Column, callees: Column) -> Column:
    """min(ln(1+in) ln(1+out) / (10 (1+complexity)), 1); 0 without callers or callees."""
    raw = F.log1p(callers) * F.log1p(callees) / (1 + F.coalesce(complexity, F.lit(0))) / 10
    return F.when((callers == 0) | (callees == 0), F.lit(0.0)).otherwise(F.least(raw, F.lit(1.0)))


def utility(transitive_callers: Column, module_fan_in: Column) -> Column:
    return F.log1p(transitive_callers) * F.log(2 + module_fan_in)


def parse_repo_url(url: str) -> dict[str, str] | None:
    """Owner, repository and, where there is one, the branch, tag or commit of a repository's web address; None for others."""
    page = r"(?:/(?:tree|commit|blob)/(?P<ref>[^/\s?#]+))?"
    m = re.fullmatch(rf"https?://(?:www\.)?[\w.-]+/(?P<owner>[^/\s]+)/(?P<repo>[^/\s?#]+?)(?:\.git)?{page}", url.strip().rstrip("/"))
    return {k: v for k, v in m.groupdict().items() if v} if m else None


def compare_url(base: str | None, repo_a: str, repo_b: str) -> str | None:
    """Address that shows two versions of one project side by side; None for different projects or without an address.

    A repo_id without a version stands for HEAD.
    """
    (a, _, ref_a), (b, _, ref_b) = repo_a.partition("@"), repo_b.partition("@")
    if a != b or not base:
        return None
    return f"{base.rstrip('/')}/compare/{ref_a.split('@')[0] or 'HEAD'}...{ref_b.split('@')[0] or 'HEAD'}"


def parse_symbol(text: str) -> tuple[str, str]:
    """Module and name of ``module::name``, parted at the first ``::``."""
    module, sep, name = text.partition("::")
    if not sep:
        raise ValueError("a symbol is module::name")
    return module, name


def format_measure(value: Column, kind: str) -> Column:
    """For display: a percentage, a whole number, or three digits, with an exponent where the number is tiny.

    Null stays null. Halves of whole numbers are rounded up.
    """
    if kind == "ratio":
        return F.when(value.isNotNull(), F.concat(F.format_string("%.1f", value.cast("double") * 100), F.lit("%")))
    if kind == "int":
        return F.floor(value.cast("double") + 0.5).cast("string")
    x = value.cast("double")
    tiny = F.regexp_replace(F.regexp_replace(F.format_string("%.2e", x), r"e([+-])0+(\d)", "e$1$2"), r"e\+?-?0$", "e+0")
    text = F.when((x != 0) & (x < 0.01), tiny).otherwise(F.format_string("%.3f", x))
    return F.when(x.isNotNull(), text)


def blend_colours(a: str, b: str, t: Column) -> Column:
    """The colour a share ``t`` of the way from ``#rrggbb`` to ``#rrggbb``."""
    ends = [(int(a[i : i + 2], 16), int(b[i : i + 2], 16)) for i in (1, 3, 5)]
    parts = [F.floor(F.greatest(F.lit(0.0), F.least(F.lit(255.0), x + (y - x) * t)) + 0.5) for x, y in ends]
    return F.concat(F.lit("#"), *[F.lpad(F.lower(F.hex(p)), 2, "0") for p in parts])


def steps(n: int) -> list[dict]:
    """Colour, line width and arrow size of 0 … n - 1 steps from a selection: from strong to faint."""
    near, far = (255, 149, 0), (255, 244, 204)
    out = []
    for i in range(n):
        t = i / (n - 1) if n > 1 else 0.0
        rgb = [int(x + (y - x) * t + 0.5) for x, y in zip(near, far)]
        out.append({"colour": f"rgb({rgb[0]},{rgb[1]},{rgb[2]})", "width": 2.8 - 2.15 * t, "arrow": int(8 - 4 * t + 0.5)})
    return out
