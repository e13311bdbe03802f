"""Event schema and the roles pages play in the churn features.

The canonical event frame every operator consumes has these columns
(operators only touch the ones they need, so Catalyst prunes the rest
at the scan):

    userId string, sessionId long, ts long (epoch milliseconds),
    page string, seq long (tie-break inside one ts), gender string,
    location string, level string, status int
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import types as T

# Page names of the music-service event log, as they
# appear in the data and must be matched exactly.
LISTEN_PAGE = "NextSong"
THUMBS_UP_PAGE = "Thumbs Up"
THUMBS_DOWN_PAGE = "Thumbs Down"
ERROR_PAGE = "Error"
ADD_PLAYLIST_PAGE = "Add to Playlist"
ADD_FRIEND_PAGE = "Add Friend"
CHURN_PAGES = ("Cancellation Confirmation", "Downgrade")


@dataclass(frozen=True)
class PageRoles:
    """Which page value plays which role. Defaults follow the music log."""

    listen: str = LISTEN_PAGE
    thumbs_up: str = THUMBS_UP_PAGE
    thumbs_down: str = THUMBS_DOWN_PAGE
    error: str = ERROR_PAGE
    add_playlist: str = ADD_PLAYLIST_PAGE
    add_friend: str = ADD_FRIEND_PAGE
    churn: tuple[str, ...] = CHURN_PAGES

    def flag_pages(self) -> dict[str, str]:
        """Flag column name -> page, in the order the features use them."""
        return {
            "listen_flag": self.listen,
            "thU_flag": self.thumbs_up,
            "thD_flag": self.thumbs_down,
            "err_flag": self.error,
            "addP_flag": self.add_playlist,
            "addF_flag": self.add_friend,
        }


DEFAULT_ROLES = PageRoles()

FLAG_COLUMNS = ("listen_flag", "thU_flag", "thD_flag", "err_flag", "addP_flag", "addF_flag")

# Session-total name and user-total name for each flag.
SESSION_MEASURES = ("sess_listens", "sess_thU", "sess_thD", "sess_err", "sess_addP", "sess_addF")
TOTAL_MEASURES = (
    "total_listens",
    "total_thumbsU",
    "total_thumbsD",
    "total_err",
    "total_add_pl",
    "total_add_fr",
)
MEAN_MEASURES = (
    "avg_sess_listens",
    "avg_sess_thU",
    "avg_sess_thD",
    "avg_sess_err",
    "avg_sess_addP",
    "avg_sess_addF",
)

# The 18 columns of the user matrix, in output order.
USER_MATRIX_COLUMNS = (
    "userId",
    "gender",
    "churn",
    "most_listens_one_month",
    "most_days_since_last_listen",
    "most_days_consec_listen",
    *TOTAL_MEASURES,
    *MEAN_MEASURES,
)

# Model features: every matrix column except userId, gender, churn,
# followed by the indexed gender -> 16 features.
FEATURE_COLUMNS = (*USER_MATRIX_COLUMNS[3:], "gender_indexed")

# Raw JSON event log of the music service. Integral JSON numbers are
# read as long, as schema inference would; the canonical frame casts.
RAW_EVENT_SCHEMA = T.StructType(
    [
        T.StructField("artist", T.StringType()),
        T.StructField("auth", T.StringType()),
        T.StructField("firstName", T.StringType()),
        T.StructField("gender", T.StringType()),
        T.StructField("itemInSession", T.LongType()),
        T.StructField("lastName", T.StringType()),
        T.StructField("length", T.DoubleType()),
        T.StructField("level", T.StringType()),
        T.StructField("location", T.StringType()),
        T.StructField("method", T.StringType()),
        T.StructField("page", T.StringType()),
        T.StructField("registration", T.LongType()),
        T.StructField("sessionId", T.LongType()),
        T.StructField("song", T.StringType()),
        T.StructField("status", T.LongType()),
        T.StructField("ts", T.LongType()),
        T.StructField("userAgent", T.StringType()),
        T.StructField("userId", T.StringType()),
    ]
)

EVENT_SCHEMA = T.StructType(
    [
        T.StructField("userId", T.StringType()),
        T.StructField("sessionId", T.LongType()),
        T.StructField("ts", T.LongType()),
        T.StructField("page", T.StringType()),
        T.StructField("seq", T.LongType()),
        T.StructField("gender", T.StringType()),
        T.StructField("location", T.StringType()),
        T.StructField("level", T.StringType()),
        T.StructField("status", T.IntegerType()),
    ]
)
