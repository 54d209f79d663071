"""URL filter with redirect equivalence.

Host and path rules judge a URL by the longest fit. Redirect and canonical-link edges join URLs into
groups (distributed connected components); a block decision reaches all aliases of a group unless
some member is explicitly allowed. A URL's own rule always wins. A node is a whole URL, query included:
the targets of a redirector are aliases of the URL that names them, not of each other.
"""
from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from maskfold.plans.materialise import materialise

from .components import components

#: action, host, path
RULES = (
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
)


def _lower(c: Column) -> Column:
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def _after_scheme(url: Column) -> Column:
    url = F.coalesce(url, F.lit(""))
    at = F.locate("://", url)
    return F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))


def host_of(url: Column) -> Column:
    """What follows the first `://` up to `/`, `?`, `#` or the end, A-Z lower-cased; empty without `://`."""
    return _lower(F.regexp_extract(_after_scheme(url), r"^([^/?#]*)", 1))


def path_of(url: Column) -> Column:
    """What follows the host up to `?`, `#` or the end; empty without `://`."""
    return F.regexp_extract(_after_scheme(url), r"^[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules: Sequence[tuple[str, str, str]] = RULES) -> Column:
    """Struct (action, rule) of the longest rule that fits host, subdomains and path prefix; else null.

    Of rules equally long, a block comes before an allow, then the earlier in the list.
    """
    order = sorted(range(len(rules)), key=lambda i: (-len(rules[i][1] + rules[i][2]), rules[i][0] != "block", i))
    found = F.lit(None).cast("struct<action:string,rule:string>")
    for i in reversed(order):
        action, h, p = rules[i]
        fits = ((host == h) | F.endswith(host, F.lit(f".{h}"))) & F.startswith(path, F.lit(p))
        found = F.when(fits, F.struct(F.lit(action).alias("action"), F.lit(h + p).alias("rule"))).otherwise(found)
    return found


def node_key(url: Column) -> Column:
    """The node that stands for a URL in the alias graph: host, path and query. The scheme, the fragment, a default
    port (80, 443) and a final dot of the host are put aside, the host's A-Z are lower-cased, an empty path is `/`; all
    else tells URLs apart. Null where there is no host."""
    host = F.regexp_replace(host_of(url), r"\.?(?::(?:80|443)?)?$", "")
    path = path_of(url)
    query = F.regexp_extract(_after_scheme(url), r"^[^?#]*(\?[^#]*)", 1)
    return F.when(host != "", F.concat(host, F.when(path == "", "/").otherwise(path), query))


TAG = r"(?i)<(?:link|meta)\b[^>]*>"
#: fixed values: the character references that stand for characters of URLs
REFERENCES = (("&quot;", '"'), ("&apos;", "'"), ("&#39;", "'"), ("&#x27;", "'"), ("&#47;", "/"), ("&#x2F;", "/"), ("&#38;", "&"), ("&#x26;", "&"), ("&amp;", "&"))


def _attribute(tag: Column, name: str) -> Column:
    """The value of an attribute, quoted or bare, `&amp;` and the like decoded; empty where it is missing."""
    value = rf"(?i)[\s\"'/]{name}\s*=\s*(?:\"([^\">]*)\"|'([^'>]*)'|([^\s\"'>]+))"
    got = F.concat(*[F.regexp_extract(tag, value, g) for g in (1, 2, 3)])
    for code, char in REFERENCES:
        got = F.regexp_replace(got, f"(?i){code}", char)
    return F.btrim(got)


def _without_dots(path: Column) -> Column:
    """`.` and `..` segments of an absolute path resolved."""
    parts = F.split(path, "/")
    empty = F.array().cast("array<string>")

    def step(acc: Column, x: Column) -> Column:
        up = F.when(F.size(acc) > 1, F.slice(acc, F.lit(1), F.size(acc) - 1)).otherwise(acc)
        return F.when(x == ".", acc).when(x == "..", up).otherwise(F.concat(acc, F.array(x)))

    done = F.aggregate(parts, empty, step)
    closed = F.when(F.element_at(parts, -1).isin(".", ".."), F.concat(done, F.array(F.lit("")))).otherwise(done)
    return F.when(path.rlike(r"/\.\.?(?:/|$)"), F.array_join(closed, "/")).otherwise(path)


def resolve(base: Column, to: Column) -> Column:
    """The URL that reference `to` names on the page `base`: absolute, `//host`, `/path`, `?query` or relative to the
    page's folder, dot segments resolved. Null for other schemes (`mailto:` and the like), empty references and mere fragments."""
    host = F.regexp_extract(F.coalesce(base, F.lit("")), r"^(.*?://[^/?#]*)", 1)
    here = F.when(path_of(base) == "", "/").otherwise(path_of(base))
    folder = F.regexp_extract(here, r"^(.*/)", 1)
    path, rest = F.regexp_extract(to, r"^([^?#]*)", 1), F.regexp_extract(to, r"^[^?#]*(.*)$", 1)
    own = F.concat(F.regexp_extract(to, r"(?i)^(https?://[^/?#]*)", 1), _without_dots(path_of(to)), F.regexp_extract(_after_scheme(to), r"^[^?#]*(.*)$", 1))
    return (
        F.when(to.rlike("(?i)^https?://"), own)
        .when((to == "") | F.startswith(to, F.lit("#")) | to.rlike("^[A-Za-z][A-Za-z0-9+.-]*:"), F.lit(None).cast("string"))
        .when(F.startswith(to, F.lit("//")), F.concat(F.lit("http:"), to))
        .when(F.startswith(to, F.lit("?")), F.concat(host, here, to))
        .when(F.startswith(to, F.lit("/")), F.concat(host, _without_dots(path), rest))
        .otherwise(F.concat(host, _without_dots(F.concat(folder, path)), rest))
    )


def link_edges(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """(src, dst) keys of all canonical links and meta refreshes in the pages' HTML, and host and path of both ends.

    Attributes may come in any order and quoting; targets are resolved by `resolve`. Null or broken HTML, pages without
    host and targets of other schemes give no edge.
    """
    tags = F.regexp_extract_all(F.coalesce(F.col(html), F.lit("")), F.lit(TAG), F.lit(0))
    found = pages.select(F.col(url).alias("u"), F.explode(tags).alias("tag")).where(F.col("tag").rlike("(?i)canonical|refresh"))
    tag = F.col("tag")
    canonical = tag.rlike(r"(?i)^<link") & F.array_contains(F.split(F.lower(_attribute(tag, "rel")), r"\s+"), "canonical")
    refresh = tag.rlike(r"(?i)^<meta") & (F.lower(_attribute(tag, "http-equiv")) == "refresh")
    # in a content attribute the target may stand in quotes of its own kind
    content = F.regexp_extract(_attribute(tag, "content"), r"""(?i)^[^;,]*[;,]\s*(?:url\s*=\s*)?["']?([^"']*)""", 1)
    found = found.select("u", F.when(canonical, _attribute(tag, "href")).when(refresh, F.btrim(content)).alias("to")).where("to is not null")
    found = found.select("u", resolve(F.col("u"), F.col("to")).alias("to"))
    ends = [f(F.col(c)).alias(n) for e, c in (("src", "u"), ("dst", "to")) for n, f in ((e, node_key), (f"{e}_host", host_of), (f"{e}_path", path_of))]
    return found.select(*ends).where("src is not null and dst is not null")


def judge(pages: DataFrame, edges: DataFrame, rules: Sequence[tuple[str, str, str]] = RULES, url: str = "url", keep: Sequence[str] = ("page_id",)) -> DataFrame:
    """One row per page: `keep`, host, path, rule, verdict, and `via`: rule, alias or default.

    `edges` holds (src, dst) keys made by `node_key`; where it has host and path of its ends, as `link_edges` gives
    them, the rules judge these too, so an end that is no page has its say in its group. URLs with the same key (which
    differ in scheme, fragment, default port or letter case of the host) are aliases without an edge.
    Null URLs and URLs without `://` have empty host and path, belong to no group and are allowed. Repeated pages are
    judged each for itself, URLs of any length are read whole, an empty table gives no rows. A column of `keep` may have
    any name but host, path, rule, verdict and via.
    """
    u = F.col(url)
    kept = [f"keep{i}" for i in range(len(keep))]
    base = pages.select(*[F.col(c).alias(k) for c, k in zip(keep, kept, strict=True)], host_of(u).alias("host"), path_of(u).alias("path"), node_key(u).alias("__key"))
    base = base.withColumn("__r", rule_of(F.col("host"), F.col("path"), rules))
    base = materialise(base, "pages")  # the URLs alone, so that the pages are read once

    action = F.col("__r.action")
    say = base.select("__key", "__r")
    if "dst_host" in edges.columns:
        edges = materialise(edges, "links")  # the pages' HTML is read once
        for e in ("src", "dst"):
            say = say.unionAll(edges.select(F.col(e), rule_of(F.col(f"{e}_host"), F.col(f"{e}_path"), rules)))
    group = components(edges.where(F.col("src") != F.col("dst")))
    votes = say.where("__key is not null and __r is not null").groupBy("__key").agg(
        F.max((action == "block").cast("int")).alias("b"), F.max((action == "allow").cast("int")).alias("a")
    )
    voted = votes.join(group.withColumnRenamed("node", "__key"), "__key", "left")
    voted = voted.withColumn("__g", F.coalesce("component", "__key"))
    spread = voted.groupBy("__g").agg(F.max("b").alias("b"), F.max("a").alias("a")).where("b = 1 and a = 0").select("__g")
    # from groups back to keys; only keys of blocked groups take part
    inside = group.join(spread.withColumnRenamed("__g", "component"), "component", "left_semi").select(F.col("node").alias("__key"))
    blocked = inside.union(spread.select(F.col("__g").alias("__key"))).distinct().withColumn("__blocked", F.lit(True))

    # pages that have a rule need no look-up, so a hot ruled key is never joined
    open_ = base.where("__r is null").join(blocked, "__key", "left")
    cols = [*[F.col(k).alias(c) for c, k in zip(keep, kept, strict=True)], "host", "path"]
    ruled = base.where("__r is not null").select(*cols, F.col("__r.rule").alias("rule"), action.alias("verdict"), F.lit("rule").alias("via"))
    hit = F.coalesce(F.col("__blocked"), F.lit(False))
    rest = open_.select(
        *cols, F.lit(None).cast("string").alias("rule"),
        F.when(hit, "block").otherwise("allow").alias("verdict"), F.when(hit, "alias").otherwise("default").alias("via"),
    )
    return reduce(DataFrame.unionAll, [ruled, rest])
