"""Change-set rules on small hand-made batches."""

from seed import SEED_TIME, seed_frames
from workboard.plans import changes
from workboard.sources import schemas as S


def test_set_task_status_accepts_any_text_and_counts(spark):
    _, _, _, _, tasks = seed_frames(spark)
    reqs = spark.createDataFrame([(1, 4, "Completed"), (2, 4, "Archived"), (3, 77, "X")],
                                 "seq long, id long, status string")
    cs = changes.set_task_status(tasks, reqs, SEED_TIME)
    row = cs.table.where("id = 4").collect()[0]
    assert row.status == "Archived" and row.completed_at == SEED_TIME  # stamp kept
    assert sorted(tuple(r) for r in cs.accepted.collect()) == [(1, 4, 1), (2, 4, 1), (3, 77, 0)]
    audit = sorted(cs.audit.collect(), key=lambda r: r.seq)
    assert [(r.seq, r.old_values.split('"Status":"')[1].split('"')[0],
             r.new_values.split('"Status":"')[1].split('"')[0]) for r in audit] == [
        (1, "Pending", "Completed"), (2, "Completed", "Archived")]


def test_create_tasks_ids_priority_and_rejects(spark):
    users, _, _, projects, tasks = seed_frames(spark)
    reqs = spark.createDataFrame([
        (10, "a", None, "bogus", None, 1, None),
        (5, "b", None, "3", None, 1, 2),
        (7, "c", None, "High", None, 9, None),
        (8, "d", None, "Low", None, 1, 99),
    ], S.TASK_CREATE_REQUESTS)
    cs = changes.create_tasks(tasks, projects, users, reqs, SEED_TIME)
    got = sorted((r.id, r.title, r.priority, r.status) for r in cs.accepted.collect())
    assert got == [(7, "b", "Critical", "Pending"), (8, "a", "Medium", "Pending")]
    assert sorted(tuple(r) for r in cs.rejected.collect()) == [(7, 9, "NOT_FOUND"),
                                                                (8, 1, "FK_VIOLATION")]
    assert cs.table.count() == 8
    assert {r.action for r in cs.audit.collect()} == {"INSERT"}


def test_projects_create_and_patch(spark):
    users, _, _, projects, _ = seed_frames(spark)
    creates = spark.createDataFrame([(2, "P2", None, 2), (1, "P1", "d", 1), (3, "P3", None, 50)],
                                    S.PROJECT_CREATE_REQUESTS)
    cs = changes.create_projects(projects, users, creates, SEED_TIME)
    assert sorted((r.id, r.name, r.is_active) for r in cs.accepted.collect()) == [
        (2, "P1", True), (3, "P2", True)]
    assert [tuple(r) for r in cs.rejected.collect()] == [(3, 50, "FK_VIOLATION")]
    patches = spark.createDataFrame([(1, 1, None, "new", False), (2, 1, "Beta", None, None),
                                     (3, 5, "x", None, None)], S.PROJECT_PATCH_REQUESTS)
    cs = changes.patch_projects(projects, patches, SEED_TIME)
    r = cs.table.collect()[0]
    assert (r.name, r.description, r.is_active, r.updated_at) == ("Beta", "new", False, SEED_TIME)
    assert [tuple(x) for x in cs.rejected.collect()] == [(3, 5, "NOT_FOUND")]


def test_roles_batch_duplicates(spark):
    users, roles, user_roles, _, _ = seed_frames(spark)
    reqs = spark.createDataFrame([(1, 2, 1), (2, 2, 1), (3, 1, 1), (4, 2, 9)],
                                 "seq long, user_id long, role_id long")
    cs = changes.assign_roles(user_roles, users, roles, reqs, SEED_TIME)
    assert [(r.user_id, r.role_id) for r in cs.accepted.collect()] == [(2, 1)]
    assert sorted((r.seq, r.reason) for r in cs.rejected.collect()) == [
        (2, "CONFLICT"), (3, "CONFLICT"), (4, "FK_VIOLATION")]
    rem = spark.createDataFrame([(1, 2, 2), (2, 2, 2), (3, 1, 2)],
                                "seq long, user_id long, role_id long")
    cs = changes.remove_roles(user_roles, rem)
    assert sorted((r.user_id, r.role_id) for r in cs.table.collect()) == [(1, 1)]
    assert sorted((r.seq, r.reason) for r in cs.rejected.collect()) == [
        (2, "NOT_FOUND"), (3, "NOT_FOUND")]


def test_patch_users_status_and_email_clash(spark):
    users, _, _, _, _ = seed_frames(spark)
    reqs = spark.createDataFrame([
        (1, 1, None, None, None, "Suspended"),
        (2, 2, "ADMIN@example.test", None, None, None),
        (3, 1, None, "Sys", None, "Nope"),
    ], S.USER_PATCH_REQUESTS)
    cs = changes.patch_users(users, reqs, SEED_TIME)
    rows = {r.id: r for r in cs.table.collect()}
    assert (rows[1].status, rows[1].first_name) == ("Suspended", "Sys")
    assert rows[2].email == "john@example.test" and rows[2].updated_at is None
    assert [tuple(r) for r in cs.rejected.collect()] == [(2, 2, "CONFLICT")]


def test_create_with_given_identity_start(spark):
    from pyspark.sql import functions as F
    users, _, _, projects, tasks = seed_frames(spark)
    reqs = spark.createDataFrame([(2, "x", None, "Low", None, 1, None),
                                  (1, "y", None, "Low", None, 1, None)], S.TASK_CREATE_REQUESTS)
    cs = changes.create_tasks(tasks, projects, users, reqs, SEED_TIME, start=F.lit(500))
    assert sorted((r.id, r.title) for r in cs.accepted.collect()) == [(501, "y"), (502, "x")]


def _users_with(spark, names):
    return spark.createDataFrame([(i, f"u{i}", e, "h", "f", "l", "Active", SEED_TIME, None) for i, e in names], S.USERS)


def _jobs_of(spark, name, build):
    sc = spark.sparkContext
    sc.setJobGroup(name, name)
    try:
        build()
        return len(sc.statusTracker().getJobIdsForGroup(name))
    finally:
        sc._jsc.clearJobGroup()


def test_asking_for_a_part_plans_that_part_alone(spark):
    users, roles, user_roles, projects, tasks = seed_frames(spark)
    tokens = spark.createDataFrame([], S.REFRESH_TOKENS)
    reqs = spark.createDataFrame([(1, 1, "t", None, "Completed", None, None, None)], S.TASK_PATCH_REQUESTS)
    sets = spark.createDataFrame([(1, 4, "Completed")], "seq long, id long, status string")
    ids = spark.createDataFrame([(1,)], "id long")
    creates = spark.createDataFrame([(10, "a", None, "bogus", None, 1, None)], S.TASK_CREATE_REQUESTS)
    own = spark.createDataFrame([(2, "P2", None, 2)], S.PROJECT_CREATE_REQUESTS)

    def build():
        cs = changes.patch_tasks(tasks, users, reqs, SEED_TIME)
        assert cs.table is not None and cs.rejected is not None
        cs = changes.set_task_status(tasks, sets, SEED_TIME)
        assert cs.table is not None and cs.rejected is not None and cs.accepted is not None
        assert changes.create_tasks(tasks, projects, users, creates, SEED_TIME).rejected is not None
        assert changes.create_projects(projects, users, own, SEED_TIME).rejected is not None
        assert changes.delete_projects(projects, tasks, ids, SEED_TIME).rejected is not None
        assert changes.delete_users(users, projects, user_roles, tokens, tasks, ids, SEED_TIME).rejected is not None

    assert _jobs_of(spark, "plan-only", build) == 0


def test_project_texts_are_held_to_the_columns(spark):
    users, _, _, projects, _ = seed_frames(spark)
    creates = spark.createDataFrame([(1, None, None, 1), (2, "n" * 101, None, 50), (3, "ok", "d" * 501, 1), (4, "n" * 100, "d" * 500, 1)],
                                    S.PROJECT_CREATE_REQUESTS)
    cs = changes.create_projects(projects, users, creates, SEED_TIME)
    assert [r.name for r in cs.accepted.collect()] == ["n" * 100]
    assert sorted(tuple(r) for r in cs.rejected.collect()) == [(1, 1, "BAD_REQUEST"), (2, 50, "BAD_REQUEST"), (3, 1, "BAD_REQUEST")]
    patches = spark.createDataFrame([(1, 1, "n" * 101, None, None), (2, 1, None, "d" * 501, None), (3, 99, "n" * 101, None, None),
                                     (4, 1, None, None, False)], S.PROJECT_PATCH_REQUESTS)
    cs = changes.patch_projects(projects, patches, SEED_TIME)
    assert sorted(tuple(r) for r in cs.rejected.collect()) == [(1, 1, "BAD_REQUEST"), (2, 1, "BAD_REQUEST"), (3, 99, "NOT_FOUND")]
    row = cs.table.where("id = 1").first()
    assert len(row.name) <= 100 and row.is_active is False


def one_by_one_claims(claims):
    a_won, b_won, won = set(), set(), []
    for seq, a, b in sorted(claims):
        if a not in a_won and b not in b_won:
            a_won.add(a)
            b_won.add(b)
            won.append(seq)
    return won


def one_by_one_emails(holders, requests):
    holds, lost = dict(holders), []
    for seq, user, key in sorted(requests):
        if any(k == key and u != user for u, k in holds.items()):
            lost.append(seq)
        else:
            holds[user] = key
    return lost


def test_claims_equal_one_by_one(spark):
    import random
    rnd = random.Random(4)
    for spread in (4, 12):
        claims = [(s, f"a{rnd.randrange(spread)}", f"b{rnd.randrange(spread)}") for s in range(60)]
        got = changes._first_claims(spark.createDataFrame(claims, "seq long, a string, b string"))
        assert sorted(r.seq for r in got.collect()) == one_by_one_claims(claims)


def test_a_long_chain_of_claims_takes_few_rounds(spark):
    # Claim i shares a key with claim i - 1 alone: every second one wins.
    claims = [(s, f"k{(s + 1) // 2}", f"m{s // 2}") for s in range(1000)]
    df = spark.createDataFrame(claims, "seq long, a string, b string")
    jobs = _jobs_of(spark, "claims", lambda: changes._first_claims(df))
    assert sorted(r.seq for r in changes._first_claims(df).collect()) == one_by_one_claims(claims) == list(range(0, 1000, 2))
    assert jobs < 150


def test_emails_equal_one_by_one(spark):
    import random
    rnd = random.Random(9)
    for spread in (6, 14):
        holders = [(u, f"e{u}") for u in range(8)]
        asked = [(s, rnd.randrange(8), f"e{rnd.randrange(spread)}") for s in range(50)]
        users = _users_with(spark, holders)
        reqs = spark.createDataFrame(asked, "seq long, id long, email string")
        got = changes._email_conflicts(users, reqs)
        assert sorted(r.seq for r in got.collect()) == one_by_one_emails(holders, asked)


def test_a_long_chain_of_emails_takes_few_rounds(spark):
    # User i takes the email that user i + 1 frees just before; the last one's is free, or never freed.
    n = 1000
    users = _users_with(spark, [(u, f"e{u}") for u in range(n + 1)])
    for last, lost in ((f"e{n + 5}", []), (f"e{n}", list(range(n)))):
        asked = [(n - 1 - u, u, last if u == n - 1 else f"e{u + 1}") for u in range(n)]
        reqs = spark.createDataFrame(asked, "seq long, id long, email string")
        found = []
        jobs = _jobs_of(spark, f"emails-{last}", lambda: found.append(changes._email_conflicts(users, reqs)))
        assert sorted(r.seq for r in found[0].collect()) == lost == one_by_one_emails([(u, f"e{u}") for u in range(n + 1)], asked)
        assert jobs < 200
