"""Text functions: truncation, escaping, slugs, URLs, actors, labels.

All are expressions of built-in functions, so they stay inside generated code.
Lengths are in code points.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def prefix(s: Column | str, n: int) -> Column:
    """First n characters."""
    return F.left(_col(s), F.lit(n))


def title(s: Column | str, n: int) -> Column:
    """If longer than n: n characters and three dots."""
    s = _col(s)
    return F.when(F.char_length(s) > n, F.concat(prefix(s, n), F.lit("..."))).otherwise(s)


def truncate(s: Column | str, n: int, mark: str = "...") -> Column:
    """At most n characters, the mark included."""
    s = _col(s)
    return F.when(F.char_length(s) > n, F.concat(prefix(s, n - len(mark)), F.lit(mark))).otherwise(s)


def intent_label(s: Column | str) -> Column:
    """At most 38 characters: cut to 37 and an ellipsis if there are over 40."""
    s = _col(s)
    return F.when(F.char_length(s) > 40, F.concat(prefix(s, 37), F.lit("…"))).otherwise(s)


def slug(s: Column | str) -> Column:
    """Lower case, everything but letters and digits a hyphen."""
    return F.regexp_replace(F.lower(_col(s)), r"[^\p{L}\p{N}]", "-")


def author_slug(name: Column | str, email: Column | str) -> Column:
    """The part of the address before @ if there is one, else the name; hyphens at the ends of a name go."""
    name, email = F.coalesce(_col(name), F.lit("")), F.coalesce(_col(email), F.lit(""))
    local = F.substring_index(email, "@", 1)
    return F.when((local != "") & (local != email), slug(local)).otherwise(F.btrim(slug(name), F.lit("-")))


def git_url(url: Column | str) -> Column:
    """``host:owner/name`` for the two known hosts, without .git at the end; other URLs as they are."""
    url = _col(url)
    known = r"^(?:git@|ssh://git@|https?://)(github|gitlab)\.com[:/](.*?)(?:\.git)*$"
    return F.when(url.rlike(known), F.regexp_replace(url, known, "$1:$2")).otherwise(url)


def pull_request_url(url: Column | str) -> Column:
    """STRUCT<owner, repo, number> of a pull-request URL, null for anything else."""
    rule = r"^(?:https?://)?github\.com/([^/]+)/([^/]+)/pull/(\d+)(?:[/?#].*)?$"
    url = _col(url)
    part = lambda i: F.regexp_extract(url, rule, i)
    number = part(3).try_cast("decimal(20,0)")
    return F.when(url.rlike(rule) & (number <= F.lit("18446744073709551615").cast("decimal(20,0)")), F.struct(part(1).alias("owner"), part(2).alias("repo"), number.alias("number")))


def issue_refs(body: Column | str) -> Column:
    """Issue numbers after fixes, closes, resolves (in this order, then by position), each once."""
    body = F.coalesce(_col(body), F.lit(""))
    found = [F.regexp_extract_all(body, F.lit(rf"(?i){word}\s*#(\d+)"), F.lit(1)) for word in ("fixes", "closes", "resolves")]
    return F.array_distinct(F.flatten(F.array(*found)))


def next_link(header: Column | str) -> Column:
    """The URL with rel=next in a Link header, null without one."""
    return F.nullif(F.regexp_extract(_col(header), r'<([^>]*)>\s*;[^,]*rel="next"', 1), F.lit(""))


def sanitize_project(path: Column | str) -> Column:
    return F.translate(_col(path), "/_", "--")


def unsanitize_project(name: Column | str) -> Column:
    """Every hyphen becomes a slash, also those that were none."""
    return F.translate(_col(name), "-", "/")


#: Tool names by category (fixed values).
TOOL_CATEGORIES = {
    "file_read": ("Read",),
    "file_search": ("Glob", "Grep"),
    "file_write": ("Write", "Edit", "NotebookEdit"),
    "shell": ("Bash",),
    "network": ("WebFetch", "WebSearch"),
    "delegation": ("Task",),
}


def tool_category(name: Column | str) -> Column:
    out = F.lit(None).cast("string")
    for category, names in TOOL_CATEGORIES.items():
        out = F.when(_col(name).isin(*names), category).otherwise(out)
    return out


def role(s: Column | str) -> Column:
    """user, assistant or system whatever the case; null for others."""
    low = F.lower(_col(s))
    return F.when(low.isin("user", "assistant", "system"), low)


#: Colours by actor type (fixed values).
ACTOR_COLOURS = {"human": "#cce5ff", "agent": "#d4edda", "tool": "#fff3cd", "ci": "#e2d5f1"}
OTHER_COLOUR = "#f8f9fa"


def actor_color(actor: Column | str) -> Column:
    out = F.lit(OTHER_COLOUR)
    for kind, colour in ACTOR_COLOURS.items():
        out = F.when(F.startswith(_col(actor), F.lit(f"{kind}:")), colour).otherwise(out)
    return out


def actor_type(actor: Column | str) -> Column:
    """What stands before the first colon."""
    return F.substring_index(_col(actor), ":", 1)


def actor_name(actor: Column | str) -> Column:
    """What follows the first colon; the whole without one."""
    return F.regexp_replace(_col(actor), r"^[^:]*:", "")


def actor_label(actor: Column | str) -> Column:
    """What follows the last colon."""
    return F.substring_index(_col(actor), ":", -1)


def escape_dot(s: Column | str) -> Column:
    out = F.replace(_col(s), F.lit("\\"), F.lit("\\\\"))
    out = F.replace(out, F.lit('"'), F.lit('\\"'))
    return F.replace(out, F.lit("\n"), F.lit("\\n"))


def escape_html(s: Column | str) -> Column:
    out = _col(s)
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def utc_text(epoch_seconds: Column | str) -> Column:
    """``yyyy-MM-ddTHH:mm:ssZ`` of seconds since 1970, which null stands for; in UTC whatever the session's zone."""
    seconds = F.coalesce(_col(epoch_seconds).cast("long"), F.lit(0))
    moment = F.timestamp_add("SECOND", seconds, F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"))
    return F.date_format(moment, "yyyy-MM-dd'T'HH:mm:ss'Z'")


def time_of_day(ts: Column | str) -> Column:
    """What stands between the first and second T, without Zs at its end; null without a T."""
    return F.regexp_replace(F.try_element_at(F.split(_col(ts), "T"), F.lit(2)), "Z+$", "")


def basename(path: Column | str) -> Column:
    return F.substring_index(_col(path), "/", -1)


def base_kind(uri: Column | str) -> Column:
    """file, document (a path or step of another document) or vcs."""
    uri = _col(uri)
    return F.when(F.startswith(uri, F.lit("file://")), "file").when(uri.rlike("^[a-z]*path:"), "document").when(uri.isNotNull(), "vcs")


def branch_spec(s: Column | str) -> Column:
    """STRUCT<name, start>: split at the first colon; start is null without one."""
    s = _col(s)
    return F.struct(F.substring_index(s, ":", 1).alias("name"), F.when(F.contains(s, F.lit(":")), F.regexp_replace(s, r"^[^:]*:", "")).alias("start"))


def branch_start(spec: Column | str) -> Column:
    """Where a branch_spec() starts: HEAD at its front stands for the branch."""
    spec = _col(spec)
    return F.when(F.startswith(spec["start"], F.lit("HEAD")), F.concat(spec["name"], F.substr(spec["start"], F.lit(5)))).otherwise(spec["start"])


def glob_to_regex(pattern: str) -> str:
    """A glob over URLs: * within a segment, ** over segments, ? one character."""
    import re

    out, i = "", 0
    while i < len(pattern):
        if pattern.startswith("**", i):
            out += ".*"
            i += 2
            continue
        out += {"*": "[^/]*", "?": "[^/]"}.get(pattern[i], re.escape(pattern[i]))
        i += 1
    return f"^{out}$"


def path_link(path: Column | str, step: Column | str | None = None) -> Column:
    """A reference to a path, or to a step of it."""
    out = F.concat(F.lit("path:"), _col(path))
    return out if step is None else F.concat(out, F.lit("/"), _col(step))


def parse_link(href: Column | str) -> Column:
    """STRUCT<path, step> of such a reference; step is null without one, all of it for other links."""
    rule = r"^[a-z]*path:([^/]+)(?:/(.+))?$"
    href = _col(href)
    return F.when(href.rlike(rule), F.struct(F.regexp_extract(href, rule, 1).alias("path"), F.nullif(F.regexp_extract(href, rule, 2), F.lit("")).alias("step")))
