"""Column functions over names, paths and identifiers."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def display_name(receiver: Column, name: Column) -> Column:
    """receiver.name, or the name alone."""
    return F.when(F.coalesce(receiver, F.lit("")) == "", name).otherwise(F.concat_ws(".", receiver, name))


def qualified_target(package: Column, receiver: Column, name: Column, module: str) -> Column:
    """Target text: the root package goes by the module path, others by their ./path."""
    return F.concat_ws(".", F.when(package == ".", F.lit(module)).otherwise(package), display_name(receiver, name))


def is_exported(name: Column) -> Column:
    return name.rlike(r"^\p{Lu}")


def is_test_file(file: Column) -> Column:
    return file.endswith("_test.go")


def is_test_for_search(kind: Column, name: Column, file: Column) -> Column:
    """A function named Test..., or any function of a test file."""
    return (kind == "function") & (name.startswith("Test") | is_test_file(file))


def is_test_for_overview(kind: Column, name: Column, file: Column) -> Column:
    """Anything in a test file, or a function with one of the four test prefixes."""
    return is_test_file(file) | ((kind == "function") & name.rlike("^(Test|Benchmark|Fuzz|Example)"))


def is_external_test_package(package_name: Column) -> Column:
    return package_name.endswith("_test")


def segments(name: Column) -> Column:
    """Lower-cased parts of an identifier: cut at . _ - / and before a capital that follows a small letter or digit."""
    cut = F.split(F.regexp_replace(name, r"(\p{Ll}|\p{Nd})(?=\p{Lu})", "$1."), r"[._/-]")
    return F.transform(F.filter(cut, lambda x: x != ""), F.lower)


def package_of_file(path: Column) -> Column:
    """./dir of a relative Go path, . for the root, null for other files and for paths outside; the path is cleaned first."""
    plain = clean_path(path)
    folder = F.regexp_extract(plain, r"^(.*)/[^/]*$", 1)
    inside = plain.endswith(".go") & ~plain.startswith("/") & ~plain.rlike(r"^\.\.(/|$)")
    return F.when(inside, F.when(folder == "", F.lit(".")).otherwise(F.concat(F.lit("./"), folder)))


def clean_path(path: Column) -> Column:
    """The shortest equal path: no empty or . part, and .. takes the part before it away where there is one."""
    parts = F.filter(F.split(F.trim(path), "/"), lambda p: (p != "") & (p != "."))
    rooted = F.trim(path).startswith("/")

    def step(done: Column, part: Column) -> Column:
        back = (part == "..") & (F.size(done) > 0) & (F.coalesce(F.element_at(done, -1), F.lit("")) != "..")
        return F.when(back, F.slice(done, F.lit(1), F.greatest(F.size(done) - 1, F.lit(0)))).when((part == "..") & rooted & (F.size(done) == 0), done).otherwise(F.concat(done, F.array(part)))

    # few paths hold a .. and need the parts in order
    joined = F.array_join(F.when(F.contains(path, F.lit("..")), F.aggregate(parts, F.array().cast("array<string>"), step)).otherwise(parts), "/")
    return F.when(rooted, F.concat(F.lit("/"), joined)).when(joined == "", F.lit(".")).otherwise(joined)


def package_of_symbol(qualified: Column) -> Column:
    """Text before the first dot after the last slash; without a slash the root."""
    return F.when(qualified.contains("/"), F.regexp_extract(qualified, r"^(.*/[^./]*)", 1)).otherwise(F.lit("."))


def local_package(import_path: Column, module: str) -> Column:
    """The ./path of an import below the module path, . for the module itself, else null."""
    rest = F.substring(import_path, len(module) + 2, 1_000_000)
    return F.when(import_path == module, F.lit(".")).when(import_path.startswith(module + "/"), F.concat(F.lit("./"), rest))


def build_tags(text: Column) -> Column:
    """Tags split at commas and white space, sorted, without repetition."""
    return F.array_sort(F.array_distinct(F.filter(F.split(text, r"[,\s]+"), lambda x: x != "")))


def unique_sorted(values: Column) -> Column:
    return F.array_sort(F.array_distinct(F.filter(values, lambda x: x != "")))


_NAME = re.compile(r"[^\W\d]\w*\Z")


def parse_target(text: str, module: str = "") -> tuple[str | None, str | None, str]:
    """(package, receiver, name) of a target text; unknown parts are None. Absolute and .. paths are refused."""
    text = text.strip()
    head, _, tail = text.rpartition("/")
    first, *rest = tail.split(".") if tail else [""]
    if not head and not text.startswith("."):
        parts = tail.split(".")
        if len(parts) <= 2 and all(map(_NAME.match, parts)):
            return None, parts[0] if len(parts) == 2 else None, parts[-1]
    if not 1 <= len(rest) <= 2 or not all(map(_NAME.match, rest)):
        raise ValueError(f"not a symbol target: {text!r}")
    path = f"{head}/{first}" if head else first
    if path.startswith("/") or ".." in path.split("/"):
        raise ValueError(f"path outside the module: {text!r}")
    if module and (path == module or path.startswith(module + "/")):
        path = path[len(module) + 1 :]
    path = path.removeprefix("./")
    return (f"./{path}" if path and path != "." else "."), (rest[0] if len(rest) == 2 else None), rest[-1]


def matches_target(target: tuple[str | None, str | None, str], *, function: bool = False) -> Column:
    """Predicate over package, receiver and name. A bare symbol name matches any receiver; a function's receiver must always agree."""
    package, receiver, name = target
    out = F.col("name") == name
    if package is not None:
        out &= F.col("package") == package
    if receiver is not None or package is not None or function:
        out &= F.coalesce(F.col("receiver"), F.lit("")) == (receiver or "")
    return out


def is_exported_method(kind: Column, receiver: Column, name: Column) -> Column:
    """A method whose name or receiver is exported."""
    return (kind == "method") & (is_exported(name) | is_exported(F.coalesce(receiver, F.lit(""))))


def confidence(warnings: Column, *modes: Column) -> Column:
    """low where there are warnings or an analysis fell back to syntax, else medium."""
    fallen = F.lit(False)
    for mode in modes:
        fallen |= F.coalesce(mode, F.lit("")).contains("ast-fallback")
    return F.when((warnings > 0) | fallen, "low").otherwise("medium")
