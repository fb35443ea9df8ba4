"""Declared schemas of the five dump tables.

Attribute names keep their ``_`` prefix and timestamps stay ISO strings until a query parses them.
"""

# Column names and types of the public data dump.
TAGS = "_Id BIGINT, _TagName STRING, _Count INT, _ExcerptPostId BIGINT, _WikiPostId BIGINT"

POST_LINKS = "_Id BIGINT, _CreationDate STRING, _PostId BIGINT, _RelatedPostId BIGINT, _LinkTypeId INT"

BADGES = "_Id BIGINT, _UserId BIGINT, _Name STRING, _Date STRING, _Class INT, _TagBased BOOLEAN"

USERS = (
    "_Id BIGINT, _Reputation INT, _CreationDate STRING, _DisplayName STRING, _LastAccessDate STRING, "
    "_AboutMe STRING, _Views INT, _UpVotes INT, _DownVotes INT"
)

POSTS = (
    "_Id BIGINT, _PostTypeId INT, _AcceptedAnswerId BIGINT, _CreationDate STRING, _Score INT, "
    "_ViewCount INT, _Body STRING, _OwnerUserId BIGINT, _LastEditorUserId STRING, "
    "_LastEditorDisplayName STRING, _LastEditDate STRING, _LastActivityDate STRING, _Title STRING, "
    "_Tags STRING, _AnswerCount INT, _CommentCount INT, _FavoriteCount INT, "
    "_CommunityOwnedDate STRING, _ContentLicense STRING"
)

DUMP_TABLES = {
    "tags": TAGS,
    "postlinks": POST_LINKS,
    "badges": BADGES,
    "users": USERS,
    "posts": POSTS,
}

QUESTION = 1
ANSWER = 2

GOLD, SILVER, BRONZE = 1, 2, 3
