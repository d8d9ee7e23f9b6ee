"""Exported pages of provider APIs (one JSON document a row) as repositories, trees, histories and contents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

REPOSITORY = "struct<full_name:string,name:string,owner:struct<login:string>,private:boolean,default_branch:string,clone_url:string>"
TREE = "struct<sha:string,truncated:boolean,tree:array<struct<path:string,mode:string,type:string,sha:string,size:bigint>>>"
COMMIT = "struct<sha:string,files:array<struct<filename:string,status:string,sha:string,previous_filename:string>>>"
# Providers by a part of the host, their names and calls allowed an hour (the last: a minute).
PROVIDERS = (("github.com", "GitHub", 5000), ("gitlab", "GitLab", 2000), ("bitbucket", "Bitbucket", 1000), ("gitea", "Gitea", 1000), ("dev.azure.com|azure|visualstudio.com", "Azure DevOps", 180))
STATUSES = ("added", "modified", "removed", "renamed", "copied", "changed")


def provider_of(url: Column) -> Column:
    """struct<name, rate_limit> of the provider that a URL's host names; null for others."""
    host = F.regexp_extract(F.lower(url), r"^[^/]*?://([^/]*)", 1)
    out = F.lit(None).cast("struct<name:string,rate_limit:int>")
    for part, name, rate in reversed(PROVIDERS):
        out = F.when(host.rlike(part.replace(".", r"\.")), F.struct(F.lit(name).alias("name"), F.lit(rate).alias("rate_limit"))).otherwise(out)
    return out


def next_link(header: Column) -> Column:
    """The URL of a Link header's next page, null on the last."""
    found = F.filter(F.split(header, ","), lambda p: F.contains(p, F.lit('rel="next"')) & F.contains(p, F.lit("<")) & F.contains(p, F.lit(">")))
    url = F.regexp_extract(F.get(found, F.lit(0)), "<([^>]*)>", 1)
    return F.when(F.size(found) > 0, url)


def retry_after(header: Column, now: Column) -> Column:
    """Seconds to wait by a Retry-After header: a number, or one of three forms of a date in GMT; null for anything else."""
    raw = F.trim(header)
    # The day's name says nothing that the date does not; Spark parses no names of days.
    bare = F.regexp_replace(F.regexp_replace(raw, r"^[A-Za-z]+,?\s+", ""), r"\s+(?:GMT|UTC|\+0000)$", "")
    at = F.coalesce(*[F.try_to_timestamp(F.regexp_replace(bare, r"\s+", " "), F.lit(form)) for form in ("d MMM yyyy HH:mm:ss", "d-MMM-yy HH:mm:ss", "MMM d HH:mm:ss yyyy")])
    return F.when(raw.rlike(r"^\+?[0-9]+$"), F.regexp_replace(raw, r"^\+", "").try_cast("long")).when(at.isNotNull(), F.greatest(F.unix_timestamp(at) - F.unix_timestamp(now), F.lit(0)).cast("long"))


def change_status(status: Column) -> Column:
    return F.when(status.isin(*STATUSES), status).otherwise("unknown")


def repositories(pages: DataFrame, column: str = "body") -> DataFrame:
    """One row for each repository of pages that hold arrays; of a full name the first page's row counts. Rows without one are left out."""
    rows = pages.select(F.posexplode(F.from_json(column, f"array<{REPOSITORY}>")).alias("pos", "r"), *[c for c in ("page",) if c in pages.columns])
    order = F.struct(*[c for c in ("page", "pos") if c in rows.columns])
    once = rows.filter("r.full_name IS NOT NULL").groupBy("r.full_name").agg(F.min_by("r", order).alias("r"))
    return once.select(
        "r.full_name",
        F.coalesce("r.owner.login", F.lit("")).alias("owner"),
        F.coalesce("r.name", F.lit("")).alias("name"),
        F.coalesce("r.private", F.lit(False)).alias("private"),
        F.coalesce("r.default_branch", F.lit("main")).alias("default_branch"),
        F.coalesce("r.clone_url", F.lit("")).alias("clone_url"),
    )


# Shapes of the repositories, tree entries and changes of providers other than the first.
GITLAB_REPOSITORY = "struct<path_with_namespace:string,visibility:string,default_branch:string,http_url_to_repo:string>"
GITLAB_ENTRY = "struct<name:string,type:string,id:string,size:bigint>"
GITLAB_CHANGE = "struct<old_path:string,new_path:string,deleted_file:boolean,renamed_file:boolean,new_file:boolean>"
BITBUCKET_REPOSITORY = "struct<full_name:string,slug:string,owner:struct<username:string>,is_private:boolean,mainbranch:struct<name:string>,links:struct<clone:array<struct<href:string,name:string>>>>"
BITBUCKET_ENTRY = "struct<path:string,type:string,commit:struct<hash:string>,size:bigint>"
AZURE_REPOSITORY = "struct<id:string,name:string,project:struct<visibility:string>,defaultBranch:string,remoteUrl:string,webUrl:string>"
AZURE_ENTRY = "struct<path:string,gitObjectType:string,isFolder:boolean,objectId:string,size:bigint>"


def _paged(pages: DataFrame, parsed: Column) -> DataFrame:
    """The elements of an array of each page with their place."""
    return pages.select(*[c for c in ("page", "project", "base") if c in pages.columns], F.posexplode(parsed).alias("pos", "r"))


def _once(rows: DataFrame, keys: list[str], columns: dict[str, Column]) -> DataFrame:
    """One row of each key, of the first page and place."""
    named = rows.select(F.struct(*[c for c in ("page", "pos") if c in rows.columns]).alias("__at"), *[c.alias(n) for n, c in columns.items()])
    rest = [n for n in columns if n not in keys]
    return named.groupBy(*keys).agg(F.min_by(F.struct(*rest), "__at").alias("r")).select(*[n if n in keys else F.col(f"r.{n}").alias(n) for n in columns])


def provider_repositories(pages: DataFrame, provider: str, column: str = "body") -> DataFrame:
    """(full_name, owner, name, private, default_branch, clone_url) of exported pages of a provider, each repository once.

    ``provider`` is github, gitea, gitlab, bitbucket or azure. Azure's pages need a column ``project``;
    there the full name is the repository's id and a repository is one of its owner and name.
    """
    if provider in ("github", "gitea"):
        return repositories(pages, column)
    text = lambda c, other="": F.coalesce(F.col(c), F.lit(other))
    if provider == "gitlab":
        rows = _paged(pages, F.from_json(column, f"array<{GITLAB_REPOSITORY}>")).filter(F.contains("r.path_with_namespace", F.lit("/")))
        name = F.substring_index("r.path_with_namespace", "/", -1)
        owner = F.regexp_replace("r.path_with_namespace", "/[^/]*$", "")
        return _once(rows, ["full_name"], {"full_name": F.col("r.path_with_namespace"), "owner": owner, "name": name, "private": F.coalesce(F.col("r.visibility").isin("private", "internal"), F.lit(False)), "default_branch": text("r.default_branch", "main"), "clone_url": text("r.http_url_to_repo")})
    if provider == "bitbucket":
        rows = _paged(pages, F.from_json(column, f"struct<values:array<{BITBUCKET_REPOSITORY}>>")["values"]).filter("r.full_name IS NOT NULL AND r.slug IS NOT NULL")
        https = F.get(F.filter("r.links.clone", lambda x: x["name"] == "https"), F.lit(0))["href"]
        return _once(rows, ["full_name"], {"full_name": F.col("r.full_name"), "owner": F.coalesce("r.owner.username", F.substring_index("r.full_name", "/", 1)), "name": F.col("r.slug"), "private": F.coalesce("r.is_private", F.lit(False)), "default_branch": text("r.mainbranch.name", "main"), "clone_url": F.coalesce(https, F.lit(""))})
    if provider == "azure":
        rows = _paged(pages, F.from_json(column, f"struct<value:array<{AZURE_REPOSITORY}>>")["value"]).filter("r.id IS NOT NULL AND r.name IS NOT NULL")
        private = F.col("r.project").isNull() | F.coalesce(F.col("r.project.visibility").isin("private", "organization"), F.lit(False))
        found = _once(rows, ["owner", "name"], {"full_name": F.col("r.id"), "owner": F.col("project"), "name": F.col("r.name"), "private": private, "default_branch": text("r.defaultBranch", "main"), "clone_url": F.coalesce("r.remoteUrl", "r.webUrl", F.lit(""))})
        return found.select("full_name", "owner", "name", "private", "default_branch", "clone_url")
    raise ValueError(f"unknown provider {provider!r}")


def provider_trees(pages: DataFrame, provider: str, column: str = "body") -> DataFrame:
    """(path, kind, sha1, size) of the entries of exported tree pages; ``base`` is a directory's path where pages are those of directories."""
    base = F.coalesce(F.col("base"), F.lit("")) if "base" in pages.columns else F.lit("")
    under = lambda path: F.when(base == "", path).otherwise(F.concat(base, F.lit("/"), path))
    if provider in ("github", "gitea"):
        return tree_pages(pages, column).select("path", "kind", "sha1", "size")
    if provider == "gitlab":
        rows = _paged(pages, F.from_json(column, f"array<{GITLAB_ENTRY}>")).filter("r.name IS NOT NULL AND r.type IS NOT NULL AND r.id IS NOT NULL")
        return rows.select(under(F.col("r.name")).alias("path"), F.col("r.type").alias("kind"), F.col("r.id").alias("sha1"), "r.size")
    if provider == "bitbucket":
        rows = _paged(pages, F.from_json(column, f"struct<values:array<{BITBUCKET_ENTRY}>>")["values"]).filter("r.path IS NOT NULL")
        kind = F.when(F.col("r.type") == "commit_file", "blob").when(F.col("r.type") == "commit_directory", "tree").otherwise(F.coalesce("r.type", F.lit("")))
        return rows.select(under(F.col("r.path")).alias("path"), kind.alias("kind"), F.coalesce("r.commit.hash", F.lit("")).alias("sha1"), "r.size")
    if provider == "azure":
        rows = _paged(pages, F.from_json(column, f"struct<value:array<{AZURE_ENTRY}>>")["value"]).filter("r.path IS NOT NULL AND r.objectId <> ''")
        kind = F.coalesce("r.gitObjectType", F.when(F.coalesce("r.isFolder", F.lit(False)), "tree").otherwise("blob"))
        return rows.select("r.path", kind.alias("kind"), F.col("r.objectId").alias("sha1"), "r.size")
    raise ValueError(f"unknown provider {provider!r}")


def change_pages(pages: DataFrame, column: str = "body") -> DataFrame:
    """(commit_sha, path, status, previous_path) of exported diffs (commit_sha, body) that tell a change by flags."""
    rows = pages.select("commit_sha", F.explode(F.from_json(column, f"array<{GITLAB_CHANGE}>")).alias("f"))
    flag = lambda c: F.coalesce(F.col(f"f.{c}"), F.lit(False))
    path = F.when(flag("deleted_file"), F.coalesce("f.old_path", "f.new_path")).otherwise(F.coalesce("f.new_path", "f.old_path"))
    status = F.when(flag("deleted_file"), "removed").when(flag("renamed_file"), "renamed").when(flag("new_file"), "added").otherwise("modified")
    return rows.select("commit_sha", path.alias("path"), status.alias("status"), F.when(flag("renamed_file"), F.col("f.old_path")).alias("previous_path")).filter("path IS NOT NULL")


def next_page(header: Column, link: Column, current: Column) -> Column:
    """The number of the next page by its own header, else by the Link header; only one beyond the current counts."""
    own = F.trim(header).try_cast("int")
    linked = F.regexp_extract(F.coalesce(next_link(link), F.lit("")), r"[?&]page=([0-9]+)", 1).try_cast("int")
    return F.coalesce(F.when(own > current, own), F.when(linked > current, linked))


def next_url(body: Column) -> Column:
    """The URL of the next page that a page itself names; null on the last."""
    found = F.get_json_object(body, "$.next")
    return F.when(found != "", found)


def continuation(header: Column) -> Column:
    """The token by which the next page is asked for; null on the last."""
    return F.when(header != "", header)


def expand_truncated(entries: DataFrame, subtrees: DataFrame, rounds: int = 64) -> DataFrame:
    """(path, kind, sha1, size) of a truncated tree with what its subtrees hold, given exported pages (tree, path, kind, sha1, size).

    Each subtree is walked once, under the first path that it is met at; a subtree without a page is left out.
    """
    out = level = entries.select("path", "kind", "sha1", "size")
    seen = None
    for _ in range(rounds):
        roots = level.filter("kind = 'tree'").groupBy("sha1").agg(F.min("path").alias("prefix"))
        roots = roots if seen is None else roots.join(seen, "sha1", "left_anti")
        known = roots.select("sha1")
        seen = known if seen is None else seen.union(known)
        level = roots.select(F.col("sha1").alias("tree"), "prefix").join(subtrees, "tree").select(F.concat("prefix", F.lit("/"), "path").alias("path"), "kind", "sha1", "size")
        level, seen = level.checkpoint(), seen.checkpoint()
        if level.isEmpty():
            return out
        out = out.union(level)
    raise RuntimeError(f"a tree is deeper than {rounds} levels")


def tree_pages(pages: DataFrame, column: str = "body") -> DataFrame:
    """(tree, truncated, path, mode, kind, sha1, size) of the entries of exported trees; entries without a path or hash are left out."""
    parsed = pages.select(F.from_json(column, TREE).alias("t")).select(F.col("t.sha").alias("tree"), F.coalesce("t.truncated", F.lit(False)).alias("truncated"), F.explode("t.tree").alias("e"))
    return parsed.filter((F.coalesce("e.path", F.lit("")) != "") & (F.coalesce("e.sha", F.lit("")) != "")).select("tree", "truncated", "e.path", "e.mode", F.col("e.type").alias("kind"), F.col("e.sha").alias("sha1"), "e.size")


def history_pages(pages: DataFrame, column: str = "body") -> DataFrame:
    """(commit_sha, path, status, blob_sha, previous_path) of the files of exported commits."""
    parsed = pages.select(F.from_json(column, COMMIT).alias("c")).select(F.col("c.sha").alias("commit_sha"), F.explode("c.files").alias("f"))
    return parsed.select("commit_sha", F.col("f.filename").alias("path"), change_status(F.col("f.status")).alias("status"), F.col("f.sha").alias("blob_sha"), F.col("f.previous_filename").alias("previous_path"))


def content_of(encoded: Column) -> Column:
    """Bytes of a content in base64 with line ends; null where it is none."""
    return F.try_to_binary(F.translate(encoded, "\r\n", ""), F.lit("base64"))
