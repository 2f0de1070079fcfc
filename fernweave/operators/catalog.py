"""Workspaces, repositories, branches and projects: who sees what."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def accessible(workspaces: DataFrame, members: DataFrame, user_id: Column | int) -> DataFrame:
    """Workspaces that a user owns or is a member of."""
    user = user_id if isinstance(user_id, Column) else F.lit(user_id)
    mine = members.where(F.col("user_id") == user).select(F.col("workspace_id").alias("id"))
    joined = workspaces.join(mine, "id", "left_semi")
    return joined.unionByName(workspaces.where(F.col("owner_id") == user)).distinct()


def shared_or_own(projects: DataFrame, workspace_id: int) -> DataFrame:
    """Projects of a workspace, and those of none (shared)."""
    return projects.where((F.col("workspace_id") == workspace_id) | F.col("workspace_id").isNull())


def name_contains(table: DataFrame, column: str, part: str) -> DataFrame:
    return table.where(F.contains(F.lower(column), F.lit(part.lower())))


def missing(wanted: DataFrame, have: DataFrame, *keys: str) -> DataFrame:
    """What a get-or-create has to create."""
    return wanted.dropDuplicates(list(keys)).join(have.select(*keys), list(keys), "left_anti")


def get_or_create(wanted: DataFrame, have: DataFrame, *keys: str) -> DataFrame:
    return have.unionByName(missing(wanted, have, *keys).select(*have.columns))


def upsert(rows: DataFrame, changes: DataFrame, keys: list[str], order: list[str] | None = None) -> DataFrame:
    """rows, with those of changes in place of rows of the same keys.

    Of several changes of one key the last by order stands; without an order they raise.
    """
    rest = [c for c in rows.columns if c not in keys]
    if order:
        last = changes.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("new"))
    else:
        twice = F.raise_error(F.lit("more than one change of a key")).cast(changes.select(F.struct(*rest).alias("s")).schema[0].dataType)
        last = changes.groupBy(*keys).agg(F.first(F.struct(*rest)).alias("new"), F.count("*").alias("n")).select(*keys, F.when(F.col("n") == 1, F.col("new")).otherwise(twice).alias("new"))
    last = last.select(*keys, *(F.col(f"new.{c}").alias(c) for c in rest))
    return rows.join(last.select(*keys), keys, "left_anti").select(*rows.columns).unionByName(last.select(*rows.columns))


def owned(workspaces: DataFrame, agent_id: int) -> DataFrame:
    return workspaces.where(F.col("owner_id") == agent_id)


def members_of(members: DataFrame, users: DataFrame, workspaces: DataFrame) -> DataFrame:
    """workspace_id, workspace, user_id, username of every member once."""
    rows = members.join(users.select(F.col("id").alias("user_id"), "username"), "user_id").join(workspaces.select(F.col("id").alias("workspace_id"), F.col("name").alias("workspace")), "workspace_id")
    return rows.select("workspace_id", "workspace", "user_id", "username").distinct()


def repositories_of(repositories: DataFrame, links: DataFrame, workspaces: DataFrame) -> DataFrame:
    """workspace_id with the columns of each repository linked to it. links (workspace_id, repository_id)."""
    known = links.join(workspaces.select(F.col("id").alias("workspace_id")), "workspace_id", "left_semi")
    return known.join(repositories.withColumnRenamed("id", "repository_id"), "repository_id")


def branches_of(branches: DataFrame, links: DataFrame, repository_id: int | None = None) -> DataFrame:
    """workspace_id with the columns of each branch linked to it, of one repository if given. links (workspace_id, branch_id)."""
    some = branches if repository_id is None else branches.where(F.col("repository_id") == repository_id)
    return links.join(some.withColumnRenamed("id", "branch_id"), "branch_id")


def branches_with_repository(branches: DataFrame, repositories: DataFrame) -> DataFrame:
    return branches.join(repositories.select(F.col("id").alias("repository_id"), F.col("name").alias("repository"), "git_url"), "repository_id")


def visible_branches(branches: DataFrame, links: DataFrame, workspace_id: int) -> DataFrame:
    mine = links.where(F.col("workspace_id") == workspace_id).select(F.col("branch_id").alias("id"))
    return branches.join(mine, "id", "left_semi")


def projects_of(projects: DataFrame, branches: DataFrame, repository_id: int, branch_name: str, workspace_id: int) -> DataFrame:
    """Projects of the branch of this name, those of the workspace and the shared ones; none if there is no such branch."""
    branch = branches.where((F.col("repository_id") == repository_id) & (F.col("name") == branch_name)).select(F.col("id").alias("branch_id"))
    return shared_or_own(projects, workspace_id).join(branch, "branch_id", "left_semi")


def unlink(links: DataFrame, gone: DataFrame, *keys: str) -> DataFrame:
    """links without the rows of gone; a row of gone that links lacks raises."""
    lost = gone.select(*keys).join(links.select(*keys), list(keys), "left_anti")
    if not lost.isEmpty():
        raise LookupError(f"no such link: {lost.first().asDict()}")
    return links.join(gone.select(*keys), list(keys), "left_anti")


def without_repository(links: DataFrame, branches: DataFrame, workspace_id: int, repository_id: int) -> DataFrame:
    """links (workspace_id, branch_id) that stay when a workspace drops a repository."""
    theirs = branches.where(F.col("repository_id") == repository_id).select(F.col("id").alias("branch_id"), F.lit(workspace_id).alias("workspace_id"))
    return links.join(theirs, ["workspace_id", "branch_id"], "left_anti")


def upsert_projects(projects: DataFrame, changes: DataFrame, order: list[str] | None = None) -> DataFrame:
    """projects with changes of their language, keyed by (workspace_id, branch_id, root_dir); shared projects stay as they are."""
    return upsert(projects, changes.where(F.col("workspace_id").isNotNull()), ["workspace_id", "branch_id", "root_dir"], order)


def users_by_login(users: DataFrame, login: str) -> DataFrame:
    return users.where((F.col("username") == login) | (F.col("email") == login))


def is_active(flag: Column) -> Column:
    """Flags come as booleans and as text."""
    return F.coalesce(F.lower(flag.cast("string")).isin("active", "true"), F.lit(False))


def token_owner(tokens: DataFrame, users: DataFrame, token_hash: Column | str, now: Column) -> DataFrame:
    """The active user behind the hash of an access token that is neither revoked nor expired."""
    wanted = token_hash if isinstance(token_hash, Column) else F.lit(token_hash)
    mine = active_tokens(tokens, now).where(F.col("token_hash") == wanted).select(F.col("user_id").alias("id"))
    return users.where(is_active(F.col("is_active"))).join(mine, "id", "left_semi")


def nest(parents: DataFrame, children: DataFrame, parent_key: str, child_key: str, name: str, fields: list[str]) -> DataFrame:
    """parents with an array of their children's fields, in order of the fields; empty for none."""
    lists = children.groupBy(F.col(child_key).alias(parent_key)).agg(F.array_sort(F.collect_list(F.struct(*fields))).alias(name))
    kind = f"array<{children.select(F.struct(*fields).alias('s')).schema[0].dataType.simpleString()}>"
    return parents.join(lists, parent_key, "left").withColumn(name, F.coalesce(name, F.array().cast(kind)))


def active_tokens(tokens: DataFrame, now: Column) -> DataFrame:
    return tokens.where(~F.col("is_revoked") & (F.col("expired_at").isNull() | (F.col("expired_at") >= now)))


def page(total: Column, per_page: int, number: Column | int) -> list[Column]:
    number, pages = number if isinstance(number, Column) else F.lit(number), F.ceil(total / per_page)
    return [pages.alias("total_pages"), (number < pages).alias("has_next"), (number > 1).alias("has_prev")]
