import pytest

from tidewatch.operators import access

SCHEMA = (
    "request_id bigint, principal string, listener string, groups array<string>, roles array<string>, "
    "operation string, resource string, resource_type string, expected boolean")
CASES = """
admin Kafka_Admins WRITE team-a-orders allow
admin Kafka_Admins DELETE team-b-inventory allow
team-a-reader TeamA_Readers READ team-a-orders allow
team-a-reader TeamA_Readers WRITE team-a-orders deny
team-a-reader TeamA_Readers READ team-b-inventory deny
team-a-writer TeamA_Writers WRITE team-a-orders allow
team-a-writer TeamA_Writers WRITE team-b-inventory deny
team-a-writer TeamA_Writers DELETE team-a-orders deny
team-a-manager TeamA_ResourceManagers ALTER_CONFIGS team-a-orders allow
team-a-manager TeamA_ResourceManagers ALTER_CONFIGS team-b-inventory deny
equities-reader Equities_Readers READ equities-trades allow
equities-reader Equities_Readers WRITE equities-trades deny
equities-reader Equities_Readers READ fi-bonds deny
equities-writer Equities_Writers WRITE equities-trades allow
equities-writer Equities_Writers WRITE equities-quotes allow
equities-writer Equities_Writers DELETE equities-trades deny
equities-writer Equities_Writers WRITE fi-yields deny
equities-manager Equities_ResourceManagers CREATE equities-swaps allow
equities-manager Equities_ResourceManagers ALTER_CONFIGS equities-trades allow
equities-manager Equities_ResourceManagers ALTER_CONFIGS fi-bonds deny
fi-reader FI_Readers READ fi-bonds allow
fi-reader FI_Readers READ equities-quotes deny
fi-writer FI_Writers WRITE fi-yields allow
fi-writer FI_Writers WRITE equities-trades deny
admin Kafka_Admins WRITE equities-trades allow
admin Kafka_Admins WRITE fi-bonds allow
admin Kafka_Admins DELETE fi-yields allow
"""


def request(i, principal, groups, operation, resource, kind="TOPIC", listener="CLIENT", roles=None, expected=None):
    return (i, principal, listener, groups, roles, operation, resource, kind, expected)


@pytest.fixture(scope="module")
def cases(spark):
    parts = [line.split() for line in CASES.strip().splitlines()]
    rows = [request(i, p, [g], op, res, expected=want == "allow") for i, (p, g, op, res, want) in enumerate(parts)]
    assert len(rows) == 27
    return spark.createDataFrame(rows, SCHEMA)


def test_published_decisions(cases):
    report = access.compare_expected(access.decide(cases)).collect()
    assert sum(r["passed"] for r in report) == 27
    assert sum(r["failed"] for r in report) == 0


def test_single_rules(spark):
    rows = [
        request(0, "x", None, "READ", "any", listener="REPLICATION"),
        request(1, "CN=cluster-operator", None, "ALTER", "any"),
        request(2, "User:admin", None, "ALTER", "any"),
        request(3, "x", None, "ALTER", "any", roles=["SystemAdmin"]),
        request(4, "x", ["Fi_ResourceManagers"], "CREATE", "kafka-cluster", "CLUSTER"),
        request(5, "x", ["Fi_ResourceManagers"], "ALTER", "kafka-cluster", "CLUSTER"),
        request(6, "User:fi-reader", None, "READ", "FI-group", "GROUP"),
        request(7, "x", ["TeamB_Readers"], "DESCRIBE", "team-b-inventory"),
        request(8, "x", ["TeamB_Readers"], "DESCRIBE", "team-bx"),
        request(9, None, None, "READ", "any"),
        request(10, "x", ["_Readers"], "READ", "-odd"),
    ]
    found = access.decide(spark.createDataFrame(rows, SCHEMA)).orderBy("request_id").collect()
    assert [r["allowed"] for r in found] == [
        True, True, True, True, True, False, True, True, False, False, True]
    assert [r["group_rule"] for r in found][6]


def test_bindings(spark, cases):
    bindings = spark.createDataFrame(access.BINDINGS, access.BINDING_SCHEMA)
    granted = {r["request_id"] for r in access.granted_by_bindings(cases, bindings).collect()}
    rows = {r["request_id"]: r for r in cases.collect()}
    # the access lists know no team-a and team-b users
    expected = {i for i, r in rows.items() if r["expected"] and not r["principal"].startswith("team-")}
    assert granted == expected


def test_binding_kinds(spark):
    bindings = spark.createDataFrame(
        [("u", "topic", "a", "literal", ["DescribeConfigs"]), ("u", "group", "*", "literal", ["All"]),
         ("u", "cluster", None, None, ["Create"])], access.BINDING_SCHEMA)
    rows = [
        request(0, "User:u", None, "DESCRIBE_CONFIGS", "a"), request(1, "u", None, "DESCRIBE_CONFIGS", "ab"),
        request(2, "u", None, "READ", "g", "GROUP"), request(3, "u", None, "CREATE", "c", "CLUSTER"),
        request(4, "u", None, "ALTER", "c", "CLUSTER"), request(5, "v", None, "READ", "g", "GROUP")]
    granted = access.granted_by_bindings(spark.createDataFrame(rows, SCHEMA), bindings)
    assert sorted(r["request_id"] for r in granted.collect()) == [0, 2, 3]


def test_rollup(cases):
    rows = access.rollup(access.decide(cases)).collect()
    assert sum(r["allowed"] for r in rows) == 15 and sum(r["denied"] for r in rows) == 12
    assert {r["team"] for r in rows} == {"team-a", "team-b", "equities", "fi"}
