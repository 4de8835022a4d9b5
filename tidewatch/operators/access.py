"""Audit of a table of access requests against role rules and against access-list bindings."""

from pyspark.sql import Column, DataFrame, functions as F

# --- fixed values: identities, groups and operations of the rules --------------------------
INTERNAL_LISTENER = "REPLICATION"
INTERNAL_PRINCIPALS = ("ANONYMOUS", "admin", "CN=cluster-operator", "CN=strimzi-cluster-operator")
ADMIN_GROUP = "Kafka_Admins"
ADMIN_ROLE = "SystemAdmin"
ADMIN_PRINCIPALS = ("admin", "User:admin", "kafka-admin")
ROLE_RULES = {
    # role: group suffix, principal suffix, operations on the team's resources
    "manager": ("_ResourceManagers", "-manager", (
        "READ", "WRITE", "CREATE", "DELETE", "ALTER", "DESCRIBE", "ALTER_CONFIGS", "DESCRIBE_CONFIGS")),
    "writer": ("_Writers", "-writer", ("WRITE", "DESCRIBE", "DESCRIBE_CONFIGS")),
    "reader": ("_Readers", "-reader", ("READ", "DESCRIBE", "DESCRIBE_CONFIGS")),
}
CLUSTER_OPERATIONS = ("DESCRIBE", "CREATE")
GROUP_OPERATIONS = ("READ", "DESCRIBE")
TEAM_SPELLINGS = {"teama": "team-a", "teamb": "team-b"}


def _user(principal: Column) -> Column:
    return F.regexp_replace(principal, "^User:", "")


def teams_of(role: str) -> Column:
    """Teams a request's principal has a role in, by its groups and by its own name."""
    group_suffix, name_suffix, _ = ROLE_RULES[role]

    def team(group: Column) -> Column:
        out = F.lower(F.left(group, F.length(group) - len(group_suffix)))
        for written, name in TEAM_SPELLINGS.items():
            out = F.replace(out, F.lit(written), F.lit(name))
        return out

    groups = F.coalesce("groups", F.array().cast("array<string>"))
    by_group = F.transform(F.filter(groups, lambda g: g.endswith(group_suffix)), team)
    user = _user(F.col("principal"))
    by_name = F.when(
        user.endswith(name_suffix), F.array(F.lower(F.left(user, F.length(user) - len(name_suffix))))
    ).otherwise(F.array().cast("array<string>"))
    return F.array_distinct(F.concat(by_group, by_name))


def _owns(teams: Column) -> Column:
    resource = F.lower("resource")
    return F.exists(teams, lambda team: resource.startswith(F.concat(team, F.lit("-"))))


def decide(requests: DataFrame) -> DataFrame:
    """Requests with one column per rule, ``allowed``, and the teams of the principal.

    Everything is an expression on the request's own row: no join and no shuffle.
    """
    rows = requests.withColumns({f"{role}_teams": teams_of(role) for role in ROLE_RULES})
    operation = F.col("operation")

    def holds(condition: Column) -> Column:
        return F.coalesce(condition, F.lit(False))

    rules = {
        "internal_rule": (F.col("listener") == INTERNAL_LISTENER)
        | F.col("principal").isin(*INTERNAL_PRINCIPALS),
        "admin_rule": holds(F.array_contains("groups", ADMIN_GROUP))
        | holds(F.array_contains("roles", ADMIN_ROLE))
        | F.col("principal").isin(*ADMIN_PRINCIPALS),
        "cluster_rule": (F.col("resource_type") == "CLUSTER")
        & operation.isin(*CLUSTER_OPERATIONS) & (F.size("manager_teams") > 0),
        "group_rule": (F.col("resource_type") == "GROUP")
        & operation.isin(*GROUP_OPERATIONS) & _owns(F.col("reader_teams")),
    }
    for role, (_, _, operations) in ROLE_RULES.items():
        rules[f"{role}_rule"] = operation.isin(*operations) & _owns(F.col(f"{role}_teams"))
    rows = rows.withColumns({name: holds(rule) for name, rule in rules.items()})
    allowed = F.lit(False)
    for name in rules:
        allowed = allowed | F.col(name)
    return rows.withColumn("allowed", allowed)


def teams(requests: DataFrame) -> DataFrame:
    """One row per request, role and team."""
    def in_role(role: str) -> Column:
        return F.transform(
            teams_of(role), lambda team: F.struct(F.lit(role).alias("role"), team.alias("team")))

    roles = F.flatten(F.array(*[in_role(role) for role in ROLE_RULES]))
    return requests.select("request_id", "principal", F.explode(roles).alias("t")).select(
        "request_id", "principal", "t.role", "t.team")


def rollup(decisions: DataFrame) -> DataFrame:
    """Allowed and denied requests per principal, resource and resource team."""
    team = F.regexp_extract(F.lower("resource"), r"^(team-[^-]+|[^-]+)-", 1)
    return decisions.groupBy("principal", team.alias("team"), "resource").agg(
        F.count_if("allowed").alias("allowed"), F.count_if(~F.col("allowed")).alias("denied"))


def compare_expected(decisions: DataFrame) -> DataFrame:
    """Passed and failed cases of requests that carry the decision they expect."""
    passed = F.col("allowed") == F.col("expected")
    return decisions.groupBy("expected", "allowed").agg(
        F.count_if(passed).alias("passed"), F.count_if(~passed).alias("failed"))


def _operation(name: Column) -> Column:
    return F.upper(F.replace(name, F.lit("_"), F.lit("")))


def granted_by_bindings(requests: DataFrame, bindings: DataFrame) -> DataFrame:
    """Requests that some binding (user, resource_type, name, pattern, operations) grants.

    A literal ``*`` and a binding without a name match every resource of its type. The join is on
    user and type; Spark broadcasts the bindings where they are small and otherwise splits a
    principal with very many requests as a skewed partition of the left side.
    """
    r, b = requests.alias("r"), bindings.alias("b")
    operations = F.transform("b.operations", _operation)
    name_matches = (
        F.col("b.name").isNull()
        | ((F.col("b.pattern") == "literal")
           & ((F.col("b.name") == "*") | (F.col("b.name") == F.col("r.resource"))))
        | ((F.col("b.pattern") == "prefix") & F.col("r.resource").startswith(F.col("b.name")))
    )
    granted = F.array_contains(operations, "ALL") | F.array_contains(operations, _operation(F.col("r.operation")))
    return r.join(
        b,
        (_user(F.col("r.principal")) == F.col("b.user"))
        & (F.lower("r.resource_type") == F.lower("b.resource_type")) & name_matches & granted,
        "left_semi",
    )


# --- fixed values: the bindings of the seven users -------------------------------------------
_ALL = ["All"]
_CLUSTER = ["Create", "Describe"]
_WRITE = ["Write", "Describe", "DescribeConfigs"]
_READ = ["Read", "Describe", "DescribeConfigs"]
_GROUP_READ = ["Read", "Describe"]
BINDINGS = [
    ("admin", "topic", "*", "literal", _ALL),
    ("admin", "group", "*", "literal", _ALL),
    ("admin", "cluster", None, None, _ALL),
    ("equities-manager", "topic", "equities-", "prefix", _ALL),
    ("equities-manager", "group", "equities-", "prefix", _ALL),
    ("equities-manager", "cluster", None, None, _CLUSTER),
    ("equities-writer", "topic", "equities-", "prefix", _WRITE),
    ("equities-reader", "topic", "equities-", "prefix", _READ),
    ("equities-reader", "group", "equities-", "prefix", _GROUP_READ),
    ("fi-manager", "topic", "fi-", "prefix", _ALL),
    ("fi-manager", "group", "fi-", "prefix", _ALL),
    ("fi-manager", "cluster", None, None, _CLUSTER),
    ("fi-writer", "topic", "fi-", "prefix", _WRITE),
    ("fi-reader", "topic", "fi-", "prefix", _READ),
    ("fi-reader", "group", "fi-", "prefix", _GROUP_READ),
]
BINDING_SCHEMA = "user string, resource_type string, name string, pattern string, operations array<string>"
