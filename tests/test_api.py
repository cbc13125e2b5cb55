from loomstone.api import Engine


def at(h):
    return f"2024-01-01 {h:02d}:00:00"


def test_writes_fold_into_reads(spark):
    e = Engine.empty(spark).remember("ann", "city", "Bern", at(1)).remember("ann", "job", "baker", at(2)).correct("ann", "city", "Basel", at(3)).forget("ann", "job", at(4))
    assert [(r.predicate, r.value) for r in e.ask_about("ann").collect()] == [("city", "Basel")]
    then = e.as_of(at(2))
    assert {(r.predicate, r.value) for r in then.ask_about("ann").collect()} == {("city", "Bern"), ("job", "baker")}
    assert e.history("ann", "city").count() == 2
    assert e.remember("ann", "city", "Bern", at(1)).log.count() == e.log.count()


def test_search_answer_and_erasure(spark):
    e = Engine.empty(spark).sync_turn("The market opens at nine. Bring a bag.", at(1)).sync_turn("Nothing else was said.", at(2))
    assert e.answer(["market"]).first().answer == "The market opens at nine."
    assert e.answer(["moon"]).count() == 0
    assert e.get_context(["market", "nothing"], 1000).count() == 2
    assert e.forbid("The market opens at nine. Bring a bag.", at(3)).answer(["market"]).count() == 0


def test_access_follows_the_last_grant(spark):
    a = Engine.empty(spark, "u:a").remember("ann", "city", "Bern", at(1))
    assert Engine(a.log, "u:b").facts().count() == 0
    g = a.grant_read("u:b", at(2))
    assert Engine(g.log, "u:b").facts().count() == 1
    assert Engine(g.revoke_read("u:b", at(3)).log, "u:b").facts().count() == 0


def test_contradictions_and_rules(spark):
    a = Engine.empty(spark, "u:a").remember("ann", "city", "Bern", at(1)).grant_read("u:b", at(2))
    b = Engine(a.log, "u:b").remember("ann", "city", "Basel", at(3)).remember("ann", "purchase", "70", at(4))
    assert b.list_contradictions().first().values == 2
    assert [r.predicate for r in b.derived().collect()] == ["is_spender"]
    assert b.set_rule_enabled("spender", False).derived().count() == 0


def test_merges_are_folded_into_facts(spark):
    e = Engine.empty(spark).remember("ann", "city", "Bern", at(1)).remember("anna", "job", "baker", at(2)).merge("ann", "anna", at(3)).merge("anna", "anna k", at(4))
    assert {(r.entity, r.predicate) for r in e.facts().collect()} == {("anna k", "city"), ("anna k", "job")}
    assert {r.entity for r in e.unmerge("anna", at(5)).facts().collect()} == {"anna"}
    assert {r.entity for r in e.as_of(at(3)).facts().collect()} == {"anna"}


def test_the_log_is_one_scan_however_long(spark):
    e = Engine.empty(spark)
    for h in range(1, 7):
        e = e.remember("ann", f"p{h}", "x", at(h))
    leaves = e.log._jdf.queryExecution().optimizedPlan().collectLeaves().size()
    assert leaves == 1 and e.log.count() == 6
    assert Engine(e.log, "u:z").remember("bob", "p", "y", at(9)).log.count() == 7 and e.log.count() == 6


def test_plans_pins_links_and_consent(spark):
    e = Engine.empty(spark).sync_turn("The market opens at nine.", at(1)).remember("ann", "city", "Bern", at(2)).pin("ann", "city", at(3))
    e = e.reflect("market was full", "go early", at(4)).add_goal("buy bread", at(5)).review_link_candidate("ann", "crm:7", True, at(6))
    assert {r.kind for r in e.plan_context(["market"]).collect()} == {"context", "pinned", "goal", "reflection"}
    assert [tuple(r) for r in e.links().collect()] == [("ann", "crm:7", "accepted")]
    assert e.explain("ann", "city").count() == 1 and e.explain("ann", "job").count() == 0
    assert e.unpin("ann", "city", at(7)).pinned().count() == 0
    assert e.expand(e.observed().first().event_id).first().text == "The market opens at nine."
    assert e.withdraw_consent(at(8)).observed().count() == 0
