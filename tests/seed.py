"""The source system's seed rows as small hand-made frames."""

from datetime import datetime, timedelta

from workboard.sources import schemas as S

SEED_TIME = datetime(2026, 1, 10, 12, 0, 0)


def seed_frames(spark, now=SEED_TIME):
    d = lambda days: now + timedelta(days=days)
    users = spark.createDataFrame([
        (1, "admin", "admin@example.test", "h1", "System", "Admin", "Active", now, None),
        (2, "johndoe", "john@example.test", "h2", "John", "Doe", "Active", now, None),
    ], S.USERS)
    roles = spark.createDataFrame([(1, "Admin", "Full system access", now),
                                   (2, "User", "Standard user access", now)], S.ROLES)
    user_roles = spark.createDataFrame([(1, 1, now), (2, 2, now)], S.USER_ROLES)
    projects = spark.createDataFrame([(1, "Project Alpha", "Demo", 1, now, None, True)],
                                     S.PROJECTS)
    rows = [
        (1, "Setup development environment", "Completed", "High", d(-5), 2),
        (2, "Design database schema", "Completed", "Critical", d(-3), 2),
        (3, "Implement user authentication", "InProgress", "Critical", d(7), 2),
        (4, "Write API documentation", "Pending", "Medium", d(14), 2),
        (5, "Performance testing", "Pending", "High", d(21), None),
        (6, "Setup CI/CD pipeline", "Pending", "Low", d(30), None),
    ]
    tasks = spark.createDataFrame(
        [(i, t, None, st, pr, due, 1, a, now, None, None) for i, t, st, pr, due, a in rows],
        S.TASKS)
    return users, roles, user_roles, projects, tasks
