"""Manifests and reports: what a reader expects, beside the comparison with SQL."""

from attestry.operators import manifests as M
from attestry.plans import contracts
from attestry.relations import rows


def test_cases_by_hand(spark):
    odd = [
        contracts._GOOD | {"manifest_id": "good", "case_id": "escaped", "method": "POST", "path": "/find", "body": '{"\\u0063reate": 1}'},
        contracts._GOOD | {"manifest_id": "good", "case_id": "broken", "path": "/orders/%zz"},
        contracts._GOOD | {"manifest_id": "good", "case_id": "nested", "path": "/orders/%2563"},
    ]
    cases = rows(spark, odd, M.CASES)
    got = M.case_faults(rows(spark, contracts.PLANS, M.PLANS), rows(spark, contracts.ACCOUNTS, M.ACCOUNTS), cases)
    assert {(r.case_id, r.fault) for r in got.collect()} == {("escaped", "body_marker"), ("broken", "path"), ("nested", "path")}


def test_whole_manifests_have_no_faults(spark):
    target = rows(spark, [t for t in contracts.TARGETS if t["manifest_id"] in ("ok", "local", "loop")], M.TARGETS)
    assert M.target_faults(target).isEmpty()
    plan = rows(spark, [contracts.PLANS[0] | {"max_requests": 4}], M.PLANS)
    accounts = rows(spark, contracts.ACCOUNTS[:2], M.ACCOUNTS)
    case = rows(spark, contracts.CASES[:1], M.CASES)
    assert M.plan_faults(plan, accounts, case).isEmpty() and M.case_faults(plan, accounts, case).isEmpty()
    report, note = rows(spark, contracts.REPORTS[:1], M.CI), rows(spark, contracts.ANNOTATIONS[:1], M.ANNOTATIONS)
    assert M.ci_faults(report, note).isEmpty()


def test_empty_tables(spark):
    none = lambda ddl: rows(spark, [], ddl)
    assert M.ci_faults(none(M.CI), none(M.ANNOTATIONS)).isEmpty() and M.option_faults(none(M.OPTIONS)).isEmpty()
    assert M.corpus_faults(none(M.CORPUS), none("rule_id string, category string")).isEmpty()
