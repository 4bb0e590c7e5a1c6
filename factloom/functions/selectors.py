"""Package and component selectors, compiled to column expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

DEFAULT_PACKAGE = "<default>"


def check_package(pattern: str) -> str:
    """The pattern, if it is `<default>`, an exact package, `base.*` or `base.**`; else a ValueError."""
    base = re.sub(r"\.\*{1,2}$", "", pattern)
    if pattern != DEFAULT_PACKAGE and not (base and all(re.fullmatch(r"(?:[^\W\d]|\$)[\w$]*", s) for s in base.split("."))):
        raise ValueError(f"no package selector: {pattern!r}")
    return pattern


def package_matches(pattern: str, package: Column) -> Column:
    """Whether a package is the exact one, a direct child (`base.*`, not the base) or in the subtree (`base.**`, with the base)."""
    check_package(pattern)
    if pattern.endswith(".**"):
        base = pattern[:-3]
        got = (package == base) | package.startswith(base + ".")
    elif pattern.endswith(".*"):
        base = pattern[:-1]
        got = package.startswith(base) & (package != base) & ~F.substring(package, len(base) + 1, 1 << 30).contains(".")
    else:
        got = package == pattern
    return F.coalesce(got, F.lit(False))


def any_package(patterns: list[str] | tuple[str, ...], package: Column) -> Column:
    out = F.lit(False)
    for p in patterns:
        out = out | package_matches(p, package)
    return out


def coordinate_matches(wanted: str, coord: Column) -> Column:
    """group:artifact matches any version of it, group:artifact:version only itself."""
    got = coord == wanted
    return F.coalesce(got | coord.startswith(wanted + ":") if wanted.count(":") == 1 else got, F.lit(False))
