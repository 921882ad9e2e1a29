"""URL verdicts: rules first, and for hosts without one link-graph trust and distrust.

Trust is a personalised PageRank from the hosts that allow rules fit; distrust is one over the reversed links from the hosts
that block rules fit (who links to a blocked host is suspect). A host is blocked when its distrust outweighs its trust
by the threshold. Everything here is DataFrame functions; each round's ranks are cut with checkpoint().
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut

#: An absolute or scheme-relative link in an attribute of the page; the host is the first group.
LINK = r"""(?i)(?:href|src)\s*=\s*["']?\s*(?:[a-z][a-z0-9+.-]*:)?//([^/?#"'\s>]+)"""
DAMPING = 0.85
ROUNDS = 10
THRESHOLD = 1.0


@dataclass(frozen=True)
class Rule:
    host: str
    path: str
    verdict: str

    @property
    def text(self) -> str:
        return self.host + self.path


#: The production rules.
RULES = (
    Rule("com", "/en/", "block"),
    Rule("example.com", "/en/7", "allow"),
    Rule("net", "/de/", "allow"),
    Rule("example.net", "/de/8", "block"),
    Rule("org", "/es/", "block"),
)
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def lower_ascii(c: Column) -> Column:
    return F.translate(c, _UPPER, _LOWER)


def host_of(url: Column) -> Column:
    """From after the first :// up to /, ?, # or the end, A-Z in lower case; empty without ://."""
    rest = F.when(F.instr(url, "://") > 0, F.substr(url, F.instr(url, "://") + 3)).otherwise(F.lit(""))
    return F.coalesce(lower_ascii(F.regexp_extract(rest, r"^[^/?#]*", 0)), F.lit(""))


def path_of(url: Column) -> Column:
    """From after the host up to ?, # or the end; empty without ://."""
    rest = F.when(F.instr(url, "://") > 0, F.substr(url, F.instr(url, "://") + 3)).otherwise(F.lit(""))
    return F.coalesce(F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules: tuple[Rule, ...]) -> Column:
    """The longest rule that fits, as a struct of its text and verdict; null where none does."""
    fits = lambda r: ((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path)
    found = F.lit(None).cast("struct<rule:string,verdict:string>")
    for r in sorted(rules, key=lambda r: (len(r.text), r.text)):
        found = F.when(fits(r), F.struct(F.lit(r.text).alias("rule"), F.lit(r.verdict).alias("verdict"))).otherwise(found)
    return found


def ranks(edges: DataFrame, seeds: DataFrame, rounds: int = ROUNDS, damping: float = DAMPING) -> DataFrame:
    """(host, rank): what a personalised PageRank brings each host over the rows (src, dst, share), a host's shares sum to one.

    The seeds share the restart evenly; a host's own restart isn't part of its result, so a seed that nothing links to has
    none. What hosts without links would pass on is lost rather than dealt out, so ranks need no global step. A round
    joins the hosts that have a rank with their links and sums by target, combined before the shuffle.
    """
    n = max(1, seeds.count())
    start = cut(seeds.select("host", F.lit(1.0 / n).alias("rank")))
    now = start
    for k in range(rounds):
        passed = now.join(edges, now.host == edges.src).select(F.col("dst").alias("host"), (F.lit(damping) * F.col("rank") * F.col("share")).alias("rank"))
        if k < rounds - 1:
            passed = passed.unionByName(start.select("host", (F.lit(1 - damping) * F.col("rank")).alias("rank")))
        now = cut(passed.groupBy("host").agg(F.sum("rank").alias("rank")))
    return now


def judge(pages: DataFrame, rules: tuple[Rule, ...] = RULES, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", rounds: int = ROUNDS, threshold: float = THRESHOLD) -> DataFrame:
    """(id, host, path, rule, verdict) of every page.

    Links are the different (host, host) pairs of pages and their absolute links, each host's weighed by its number of pages
    with them; links to itself don't count. Seeds are the hosts with a page that a rule fits. A host is blocked when the
    distrust that links bring it is more than threshold times the trust; one that links bring nothing is allowed. Null urls and
    urls without :// have the empty host, which has no links. Null html has no links. Repeated rows each have their row; an
    empty table gives an empty result. Other columns are not read.
    """
    at = pages.select(F.col(id_col).alias("id"), host_of(F.col(url_col)).alias("host"), path_of(F.col(url_col)).alias("path"))
    at = at.withColumn("found", rule_of(F.col("host"), F.col("path"), rules))
    linked = pages.select(host_of(F.col(url_col)).alias("src"), F.explode(F.array_distinct(F.regexp_extract_all(F.col(html_col), F.lit(LINK), F.lit(1)))).alias("dst"))
    linked = linked.withColumn("dst", lower_ascii(F.regexp_replace("dst", r"^[^@]*@|:\d*$", ""))).where("src <> '' and dst <> '' and src <> dst")
    pairs = cut(linked.groupBy("src", "dst").agg(F.count("*").alias("pages")))
    blocked = pairs.select(F.col("src").alias("host")).limit(0)
    if not pairs.isEmpty():
        by_src, by_dst = (pairs.groupBy(k).agg(F.sum("pages").alias("all")) for k in ("src", "dst"))
        forward = pairs.join(by_src, "src").select("src", "dst", (F.col("pages") / F.col("all")).alias("share"))
        backward = pairs.join(by_dst, "dst").select(F.col("dst").alias("src"), F.col("src").alias("dst"), (F.col("pages") / F.col("all")).alias("share"))
        seeds = cut(at.where("found is not null and host <> ''").select("host", "found.verdict").distinct())
        trust = ranks(cut(forward), seeds.where("verdict = 'allow'").select("host"), rounds)
        distrust = ranks(cut(backward), seeds.where("verdict = 'block'").select("host"), rounds)
        both = trust.select("host", F.col("rank").alias("trust"), F.lit(0.0).alias("distrust")).unionByName(distrust.select("host", F.lit(0.0).alias("trust"), F.col("rank").alias("distrust")))
        sums = both.groupBy("host").agg(F.sum("trust").alias("trust"), F.sum("distrust").alias("distrust"))
        blocked = sums.where(F.col("distrust") > F.lit(threshold) * F.col("trust")).select("host")
    out = at.join(blocked.withColumn("by_links", F.lit("block")), "host", "left")
    return out.select("id", "host", "path", F.col("found.rule").alias("rule"), F.coalesce("found.verdict", "by_links", F.lit("allow")).alias("verdict"))


def judge_sql(rules: tuple[Rule, ...] = RULES, rounds: int = ROUNDS, damping: float = DAMPING, threshold: float = THRESHOLD) -> str:
    """judge(pages) for DuckDB; the rounds are written out one by one."""
    q = lambda x: "'" + x.replace("'", "''") + "'"
    fits = lambda r: f"(host = {q(r.host)} or ends_with(host, {q('.' + r.host)})) and starts_with(path, {q(r.path)})"
    ordered = sorted(rules, key=lambda r: (-len(r.text), r.text))
    case = lambda what: "case " + " ".join(f"when {fits(r)} then {q(what(r))}" for r in ordered) + " end"
    parts = [
        "rest as (select page_id, html, case when instr(url, '://') > 0 then substr(url, instr(url, '://') + 3) else '' end as rest from pages)",
        f"cut_up as (select page_id, html, translate(regexp_extract(rest, '^[^/?#]*'), {q(_UPPER)}, {q(_LOWER)}) as host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) as path from rest)",
        f"placed as (select *, {case(lambda r: r.text)} as rule, {case(lambda r: r.verdict)} as by_rule from cut_up)",
        f"linked as (select host as src, unnest(list_distinct(regexp_extract_all(html, {q(LINK)}, 1))) as dst from cut_up)",
        f"cleaned as (select src, translate(regexp_replace(dst, '^[^@]*@|:\\d*$', '', 'g'), {q(_UPPER)}, {q(_LOWER)}) as dst from linked)",
        "pairs as (select src, dst, count(*) as pages from cleaned where src <> '' and dst <> '' and src <> dst group by all)",
        "forward as (select src, dst, pages / sum(pages) over (partition by src) as share from pairs)",
        "backward as (select dst as src, src as dst, pages / sum(pages) over (partition by dst) as share from pairs)",
    ]
    for name, edges, verdict in (("trust", "forward", "allow"), ("distrust", "backward", "block")):
        parts.append(f"{name}_seeds as (select distinct host from placed where by_rule = '{verdict}' and host <> '')")
        parts.append(f"{name}0 as (select host, 1.0::double / (select count(*) from {name}_seeds) as rank from {name}_seeds)")
        for k in range(1, rounds + 1):
            passed = f"select dst as host, {damping}::double * rank * share as rank from {name}{k - 1} join {edges} on host = src"
            if k < rounds:
                passed += f" union all select host, {1 - damping}::double * rank from {name}0"
            parts.append(f"{name}{k} as (select host, sum(rank) as rank from ({passed}) group by host)")
    parts.append(f"blocked as (select d.host from distrust{rounds} d left join trust{rounds} t on d.host = t.host where d.rank > {threshold}::double * coalesce(t.rank, 0))")
    return "with " + ",\n".join(parts) + "\nselect page_id, placed.host, path, rule, coalesce(by_rule, case when blocked.host is not null then 'block' end, 'allow') as verdict from placed left join blocked on placed.host = blocked.host"
