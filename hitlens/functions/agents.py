"""User-agent rules: ordered, first match wins, case-insensitive.

A rule is a SQL ``LIKE`` pattern over the lower-cased agent, which Catalyst turns into
substring searches. The whole classification is a narrow expression: no shuffle, no
broadcast, and columns nobody reads are pruned with their patterns.
"""

from pyspark.sql import Column, functions as F

BOT = ("%bot%", "%crawl%", "%spider%", "%slurp%")
MOBILE = ("%iphone%", "%ipod%", "%android%mobile%", "%windows phone%")

BROWSERS = (
    (("%googlebot%",), "Googlebot"),
    (("%bingbot%",), "Bingbot"),
    (BOT, "Other Bot"),
    (("%edg/%",), "Edge"),
    (("%opr/%",), "Opera"),
    (("%firefox/%",), "Firefox"),
    (("%chrome/%mobile%",), "Chrome Mobile"),
    (("%chrome/%",), "Chrome"),
    (("%version/%mobile%safari%",), "Mobile Safari"),
    (("%version/%safari%",), "Safari"),
    (("%curl/%",), "curl"),
)
SYSTEMS = (
    (("%windows%",), "Windows"),
    (("%iphone%", "%ipad%", "%ipod%"), "iOS"),
    (("%android%",), "Android"),
    (("%mac os x%",), "Mac OS X"),
    (("%linux%", "%x11%"), "Linux"),
)
DEVICES = (
    (BOT, "Spider"),
    (("%iphone%",), "iPhone"),
    (("%ipad%",), "iPad"),
    (("%ipod%",), "iPod"),
    (("%android%",), "Android"),
    (("%mac os x%",), "Mac"),
)
# Token whose following digits are the version, tried in order.
VERSION_TOKENS = ("googlebot", "bingbot", "edg", "opr", "firefox", "chrome", "version", "curl")

RULES = {"browser": BROWSERS, "os": SYSTEMS, "device": DEVICES}


def _like(agent: str, pattern: str) -> str:
    """A pattern of several parts needs a regex: search for its first part before."""
    parts = pattern.strip("%").split("%")
    test = f"lower({agent}) like '{pattern}'"
    return test if len(parts) == 1 else f"(lower({agent}) like '%{parts[0]}%' and {test})"


def _any_like(agent: str, patterns) -> str:
    return "(" + " or ".join(_like(agent, p) for p in patterns) + ")"


def classify(agent: str, rules) -> Column:
    """Name given by the first rule that matches the agent column; Unknown for null."""
    cases = " ".join(f"when {_any_like(agent, patterns)} then '{name}'" for patterns, name in rules)
    return F.expr(f"case when {agent} is null then 'Unknown' {cases} else 'Other' end")


def browser_version(agent: str) -> Column:
    """Version text after the first known token; null when it has none."""
    cases = " ".join(
        f"when lower({agent}) like '%{token}/%' then "
        f"nullif(regexp_extract(lower({agent}), '{token}/([0-9][0-9.]*)', 1), '')"
        for token in VERSION_TOKENS)
    return F.expr(f"case {cases} end")


def _flag(agent: str, patterns) -> Column:
    return F.expr(f"cast(coalesce({_any_like(agent, patterns)}, false) as int)")


def is_mobile(agent: str) -> Column:
    return _flag(agent, MOBILE)


def is_bot(agent: str) -> Column:
    return _flag(agent, BOT)


def agent_columns(agent: str, rules=None) -> dict[str, Column]:
    """All agent features of a column (or SQL expression); ``rules`` replaces lists by name."""
    rules = {**RULES, **(rules or {})}
    return {
        "browser": classify(agent, rules["browser"]),
        "browser_version": browser_version(agent),
        "os": classify(agent, rules["os"]),
        "device": classify(agent, rules["device"]),
        "is_mobile": is_mobile(agent),
        "is_bot": is_bot(agent),
    }
