"""URL rules whose block decisions spread over redirects and canonical links; explicit allow rules come first."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import clear, stash, stashes, table
from .components import connected_components

#: Rules of the query: host, path, verdict.
RULES = (("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block"))
#: Rule tables up to so many rows are looked through row by row; up to so many are broadcast, larger ones joined by a shuffle on the host.
FEW_RULES, SMALL_RULES = 50, 10_000
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_table(spark: SparkSession, rules=RULES) -> DataFrame:
    quoted = ", ".join("(" + ", ".join("'" + x.replace("\\", "\\\\").replace("'", "\\'") + "'" for x in rule) + ")" for rule in rules)
    return spark.sql(f"select * from values {quoted} as rules(host, path, verdict)")


def _ruled(rows: DataFrame, rules: DataFrame) -> DataFrame:
    """Adds rule and verdict of the longest fitting rule (of equal ones the longer host, then allow), or nulls, to rows with host and path.

    A few rules are part of the plan, and nothing is joined. Of more, hosts are looked up once each: every host meets the rules
    of its suffixes, and its few candidates, written to the shared folder, go back to the rows.
    """
    few = rules.select("host", "path", "verdict").limit(FEW_RULES + 1).collect()
    if 0 < len(few) <= FEW_RULES:
        entry = lambda h, p, v: F.struct(F.lit(len(h + p)).alias("n"), F.lit(len(h)).alias("m"), F.lit(int(v == "allow")).alias("allow"), F.lit(h + p).alias("rule"), F.lit(v).alias("verdict"), F.lit(h).alias("host"), F.lit(p).alias("path"))
        ours = lambda x: ((F.col("host") == x["host"]) | F.endswith(F.col("host"), F.concat(F.lit("."), x["host"]))) & F.startswith(F.col("path"), x["path"])
        found = rows.withColumn("_best", F.array_max(F.filter(F.array(*(entry(*r) for r in few if None not in r)), ours)))
        return found.withColumn("rule", F.col("_best.rule")).withColumn("verdict", F.col("_best.verdict")).drop("_best")
    small = rules.limit(SMALL_RULES + 1).count() <= SMALL_RULES
    hint = F.broadcast if small else (lambda x: x)
    by_host = rules.groupBy(F.col("host").alias("suffix")).agg(F.collect_list(F.struct((F.length("host") + F.length("path")).alias("n"), F.length("host").alias("m"), F.when(F.col("verdict") == "allow", 1).otherwise(0).alias("allow"), F.col("path"), F.concat("host", "path").alias("rule"), "verdict")).alias("r"))
    labels = F.split("host", r"\.")
    hosts = rows.select("host").distinct().select("host", F.explode(F.transform(F.sequence(F.lit(1), F.size(labels)), lambda k: F.array_join(F.slice(labels, k, F.size(labels)), "."))).alias("suffix"))
    # written, so that the join below has a shuffle of its own and the rows of a large host are split as skew
    fits = stash(hosts.join(hint(by_host), "suffix").groupBy("host").agg(F.flatten(F.collect_list("r")).alias("r")))
    best = F.array_max(F.filter("r", lambda x: F.startswith(F.col("path"), x["path"])))
    return rows.join(fits, "host", "left").withColumn("_best", best).withColumn("rule", F.col("_best.rule")).withColumn("verdict", F.col("_best.verdict")).drop("r", "_best")


def _without_dots(path: Column) -> Column:
    """The path with its segments . and .. carried out."""
    parts = F.split(path, "/")
    kept = F.aggregate(
        F.slice(parts, 2, F.size(parts)), F.array().cast("array<string>"),
        lambda a, x: F.when(x == "..", F.slice(a, 1, F.greatest(F.size(a) - 1, F.lit(0)))).when(x == ".", a).otherwise(F.array_append(a, x)),
        lambda a: F.when(F.element_at(parts, -1).isin(".", ".."), F.array_append(a, F.lit(""))).otherwise(a),
    )
    return F.when(path.rlike(r"/\.\.?(?:/|$)"), F.concat(F.lit("/"), F.array_join(kept, "/"))).otherwise(path)


def resolve(url: Column, target: Column) -> Column:
    """The address that a link on the page ``url`` leads to, without query if it is relative; null if it is of another kind (``mailto:``) or empty.

    Targets with a host stay as they are; others take the page's host, and paths that do not start at the root the page's folder.
    """
    page = F.regexp_extract(url, r"(?s)^(.*?://[^/?#]*)", 1)
    path = F.regexp_extract(target, r"(?s)^([^?#]*)", 1)
    folder = F.when(path_of(url) == "", "/").otherwise(F.regexp_extract(path_of(url), r"(?s)^(.*/)", 1))
    here = F.when(path == "", path_of(url)).when(F.startswith(path, F.lit("/")), _without_dots(path)).otherwise(_without_dots(F.concat(folder, path)))
    other = target.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:")
    return F.when(target.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*://"), target).when(F.startswith(target, F.lit("//")), F.concat(F.lit("http:"), target)).when(~other & (target != "") & (page != ""), F.concat(page, here))


def page_links(pages: DataFrame) -> DataFrame:
    """(source, target): canonical and refresh links of ``pages(url, html)``, relative ones resolved against the page's url."""
    html = F.col("html")
    canonical = F.regexp_extract(F.regexp_extract(html, r"(?is)<link\b[^>]*\brel\s*=\s*[\"']?canonical\b[^>]*>", 0), r"(?is)\bhref\s*=\s*[\"']?([^\"'\s>]+)", 1)
    refresh = F.regexp_extract(F.regexp_extract(html, r"(?is)<meta\b[^>]*\bhttp-equiv\s*=\s*[\"']?refresh\b[^>]*>", 0), r"(?is)\burl\s*=\s*['\"]?([^\"'\s>]+)", 1)
    tagged = pages.where("url is not null and html is not null").where(html.rlike(r"(?i)\bcanonical\b|http-equiv"))
    return tagged.select("url", F.explode(F.array(canonical, refresh)).alias("t")).where("t <> ''").select(F.col("url").alias("source"), resolve(F.col("url"), F.col("t")).alias("target")).where("target is not null")


def judge(pages: DataFrame, rules: DataFrame, redirects: DataFrame | None = None) -> DataFrame:
    """(page_id, host, path, rule, verdict, spread) of every row of ``pages(page_id, url, html)``.

    rule: the longest rule that fits, else null; it decides. Pages without one take the decision of their component over
    redirect (``redirects(source, target)``) and canonical-link edges: allow if any address in it has an allow rule, else
    block if any has a block rule, else allow; spread tells that such a block was passed on. Addresses are nodes by host
    and path. Null urls and urls without ``://`` have empty host and path, no rule and no links: allow. Repeated rows stay;
    an empty table gives no rows; columns of other names are ignored.
    """
    mark = stashes()
    key = lambda url: F.concat(host_of(url), F.when(path_of(url) == "", "/").otherwise(path_of(url)))
    rows = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    ruled = _ruled(rows, rules)
    links = page_links(pages)
    if redirects is not None:
        links = links.unionByName(redirects.select("source", "target"))
    edges = stash(links.select(key(F.col("source")).alias("a"), key(F.col("target")).alias("b")).where("a <> b").distinct())
    ruled = ruled.withColumn("node", F.concat("host", F.when(F.col("path") == "", "/").otherwise(F.col("path"))))
    parts = connected_components(edges)
    nodes = parts.select("node", "component", F.regexp_extract("node", "(?s)^([^/]*)", 1).alias("host"), F.regexp_extract("node", "(?s)^[^/]*(.*)$", 1).alias("path"))
    fate = _ruled(nodes, rules).groupBy("component").agg(F.max(F.col("verdict") == "allow").alias("allow"), F.max(F.col("verdict") == "block").alias("block"))
    spread = parts.join(fate.where("block and not coalesce(allow, false)").select("component"), "component").select("node", F.lit(True).alias("spread"))
    out = ruled.join(spread, "node", "left")
    passed = F.coalesce("spread", F.lit(False)) & F.col("rule").isNull()
    out = stash(out.select("page_id", "host", "path", "rule", F.coalesce("verdict", F.when(passed, "block").otherwise("allow")).alias("verdict"), passed.alias("spread")))
    clear(pages.sparkSession, mark, out)
    return out


def op3_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "pages").select("page_id", "url", "html"), rule_table(spark))


OP3_SQL = r"""
with recursive p as (select page_id, url, html, coalesce(translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') as host,
  coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') as path, row_number() over () as rid from pages),
r(h, q, v) as (values ('org', '/', 'allow'), ('example.org', '/es/', 'block'), ('example.org', '/en/1', 'block'), ('com', '/fr/', 'allow'), ('com', '/de/', 'block')),
tag as (select url, path, unnest([regexp_extract(regexp_extract(html, '(?is)<link\b[^>]*\brel\s*=\s*["'']?canonical\b[^>]*>'), '(?is)\bhref\s*=\s*["'']?([^"''\s>]+)', 1),
  regexp_extract(regexp_extract(html, '(?is)<meta\b[^>]*\bhttp-equiv\s*=\s*["'']?refresh\b[^>]*>'), '(?is)\burl\s*=\s*["'']?([^"''\s>]+)', 1)]) as t from p where url is not null and html is not null),
cut as (select url, t, path as own, regexp_extract(url, '(?s)^(.*?://[^/?#]*)', 1) as page, regexp_extract(t, '(?s)^([^?#]*)', 1) as rel, case when path = '' then '/' else regexp_extract(path, '(?s)^(.*/)', 1) end as folder from tag where t <> ''),
whole as (select *, case when starts_with(rel, '/') then rel else folder || rel end as raw from cut),
dots as (select *, case when not regexp_matches(raw, '/\.\.?(?:/|$)') then raw else coalesce(list_reduce(string_split(raw, '/')[2:], lambda a, x: case x when '..' then regexp_replace(a, '/[^/]*$', '') when '.' then a else a || '/' || x end, ''), '')
  || case when regexp_matches(raw, '/\.\.?$') then '/' else '' end end as plain from whole),
link as (select url, case when regexp_matches(t, '^[A-Za-z][A-Za-z0-9+.-]*://') then t when starts_with(t, '//') then 'http:' || t
  when not regexp_matches(t, '^[A-Za-z][A-Za-z0-9+.-]*:') and page <> '' then page || case when rel = '' then own else plain end end as target from dots),
ends as (select translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as ha, regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1) as pa,
  translate(regexp_extract(target, '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as hb, regexp_extract(target, '(?s)^.*?://[^/?#]*([^?#]*)', 1) as pb from link where target is not null),
edge as (select ha || case pa when '' then '/' else pa end as a, hb || case pb when '' then '/' else pb end as b from ends),
both_ways as (select a, b from edge where a <> b union select b, a from edge where a <> b),
reach(a, b) as (select a, b from both_ways union select reach.a, e.b from reach join both_ways e on e.a = reach.b),
node as (select distinct b as node, regexp_extract(b, '(?s)^([^/]*)', 1) as host, regexp_extract(b, '(?s)^[^/]*(.*)$', 1) as path from reach),
place as (select 'p' || rid as id, host, path from p union all select 'n' || node, host, path from node),
fit as (select id, arg_max(h || q, length(h || q) * 1000000 + length(h) * 10 + (v = 'allow')::int) as rule, arg_max(v, length(h || q) * 1000000 + length(h) * 10 + (v = 'allow')::int) as verdict
  from place join r on (host = h or ends_with(host, '.' || h)) and starts_with(path, q) group by id),
fate as (select a as node, coalesce(bool_or(verdict = 'allow'), false) as allowed, coalesce(bool_or(verdict = 'block'), false) as blocked from reach left join fit on fit.id = 'n' || b group by a),
out as (select page_id, p.host, p.path, rule, verdict, rule is null and coalesce(blocked and not allowed, false) as spread
  from p left join fit on fit.id = 'p' || rid left join fate on fate.node = p.host || case p.path when '' then '/' else p.path end)
select page_id, host, path, rule, coalesce(verdict, case when spread then 'block' else 'allow' end) as verdict, spread from out
"""
