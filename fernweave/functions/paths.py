"""Paths and repository addresses as expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The language of each file suffix.
SUFFIXES = {
    "python": (".py", ".pyi"),
    "javascript": (".js", ".jsx", ".mjs", ".cjs"),
    "typescript": (".ts", ".tsx", ".mts", ".cts"),
}


def suffix(path: Column) -> Column:
    """The last suffix, lower-cased; "" for none, and for names that only start with a dot."""
    return F.lower(F.regexp_extract(path, r"[^/](\.[^./]+)$", 1))


def language(path: Column) -> Column:
    """Null where the suffix is not of a known language."""
    out = F.lit(None).cast("string")
    for name, suffixes in SUFFIXES.items():
        out = F.when(suffix(path).isin(*suffixes), name).otherwise(out)
    return out


def parser_name(path: Column) -> Column:
    return F.when(suffix(path) == ".tsx", "tsx").otherwise(language(path))


def normalize(path: Column) -> Column:
    """A relative posix path without `.` and empty segments; null where it is absolute, empty, on a drive or leaves its root."""
    slashed = F.replace(F.trim(path), F.lit("\\"), F.lit("/"))
    segments = F.filter(F.split(slashed, "/"), lambda s: (s != "") & (s != "."))
    bad = slashed.startswith("/") | F.rlike(slashed, F.lit("^[A-Za-z]:")) | F.array_contains(segments, "..") | (F.size(segments) == 0)
    return F.when(~bad, F.array_join(segments, "/"))


def normalize_scip(path: Column) -> Column:
    """Backslashes to slashes, and one leading `./` off."""
    return F.regexp_replace(F.replace(path, F.lit("\\"), F.lit("/")), r"^\./", "")


def github_url(url: Column) -> Column:
    """struct(owner, repository, clone_url) of a public repository address, or null.

    https, a host github.com or www.github.com without port, user, query or fragment, and two segments of
    [A-Za-z0-9_.-] (percent-decoded, `.git` off), neither `.` nor `..`.
    """
    path = F.regexp_extract(F.trim(url), r"(?i)^https://(?:www\.)?github\.com/([^?#@:]+)$", 1)
    plain = F.rlike(path, F.lit("%(?![0-9A-Fa-f]{2})"))
    parts = F.split(F.regexp_replace(F.when(plain, "").otherwise(F.try_url_decode(F.replace(path, F.lit("+"), F.lit("%2B")))), "/$", ""), "/")
    owner, repository = F.get(parts, F.lit(0)), F.regexp_replace(F.get(parts, F.lit(1)), r"\.git$", "")
    fine = lambda c: F.rlike(c, F.lit("^[A-Za-z0-9_.-]+$")) & ~c.isin(".", "..")
    clone = F.concat(F.lit("https://github.com/"), owner, F.lit("/"), repository, F.lit(".git"))
    return F.when((F.size(parts) == 2) & fine(owner) & fine(repository), F.struct(owner.alias("owner"), repository.alias("repository"), clone.alias("clone_url")))


def gitignore_regexes(lines: list[str]) -> list[tuple[bool, str]]:
    """(negated, regex) for each pattern of an ignore file, in order; the regexes match whole relative paths.

    The last pattern that matches decides. A directory pattern takes what is under it along.
    """
    rules = []
    for line in lines:
        line = line.rstrip("\n").rstrip("\r")
        if not line.endswith("\\ "):
            line = line.rstrip(" ")
        if not line or line.startswith("#"):
            continue
        negated = line.startswith("!")
        line = line[1:] if negated else line
        line = line[1:] if line[:2] in ("\\#", "\\!") else line
        directory = line.endswith("/")
        body = line.rstrip("/")
        anchored = "/" in body
        body = body.lstrip("/")
        out, at = "", 0
        while at < len(body):
            c = body[at]
            if body.startswith("**/", at) and (at == 0 or body[at - 1] == "/"):
                out, at = out + "(?:[^/]+/)*", at + 3
            elif body.startswith("/**", at) and at + 3 == len(body):
                out, at = out + "/.+", at + 3
            elif c == "*":
                alone = (at == 0 or body[at - 1] == "/") and body[at + 1 : at + 2] in ("", "/")
                out, at = out + ("[^/]+" if alone else "[^/]*"), at + 1
            elif c == "?":
                out, at = out + "[^/]", at + 1
            elif c == "[" and "]" in body[at + 2 :]:
                end = body.index("]", at + 2)
                inner = body[at + 1 : end].replace("\\", "\\\\")
                out, at = out + "[" + ("^" + inner[1:] if inner[0] in "!^" else inner) + "]", end + 1
            else:
                if c == "\\" and at + 1 < len(body):
                    at, c = at + 1, body[at + 1]
                out, at = out + ("\\" + c if not c.isalnum() and ord(c) < 128 else c), at + 1
        rules.append((negated, ("^" if anchored else "^(?:.*/)?") + out + ("/.*$" if directory else "(?:/.*)?$")))
    return rules


def ignored(path: Column, lines: list[str]) -> Column:
    """Does the last matching pattern ignore this path? Directories are asked about with a trailing slash."""
    out = F.lit(False)
    for negated, regex in gitignore_regexes(lines):
        out = F.when(F.rlike(path, F.lit(regex)), F.lit(not negated)).otherwise(out)
    return out
