"""Records from social posts."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions import vocab as V
from ..functions.text import cascade, contains_any, deadline_in_text, first_nonblank, reward_in_text, strip, text, url_in_post


def relevant_posts(posts: DataFrame) -> DataFrame:
    return posts.where(contains_any(F.lower(F.concat_ws(" ", text("title"), text("body"))), V.POST_KEYWORDS))


def post_records(posts: DataFrame, *keys: str) -> DataFrame:
    """Posts (title, body, url, permalink, channel) as records.

    ``topic`` decides tags and extra fields, ``category`` the dataset: the two
    rules differ on purpose.
    """
    p = posts.withColumn("_title", strip(text("title"))).withColumn("_body", strip(text("body")))
    p = p.withColumn("_full", F.concat_ws(" ", "_title", "_body"))
    p = p.withColumns({"topic": cascade(F.lower("_full"), V.POST_CATEGORY, "competitions"), "_reward": reward_in_text("_full"),
                       "_link": F.coalesce(url_in_post("url", "body"), text("permalink")), "name": F.col("_title"),
                       "description": first_nonblank("_body", "_title")})
    topic, reward = F.col("topic"), F.col("_reward")
    slug = F.lower(F.regexp_replace(F.col("_title"), "[^a-zA-Z0-9]", ""))
    prize = F.when(topic == "hackathons", F.coalesce(reward, F.lit("Community Hackathon"))).when(topic == "competitions", F.coalesce(reward, F.lit("Prizes & Recognition")))
    stipend = F.when(topic == "internships", F.coalesce(reward, F.lit("Competitive / Check listing"))).when(topic == "open-source-programs", F.coalesce(reward, F.lit("Stipend / Mentorship")))
    return p.select(
        *keys, F.concat_ws("-", F.lit("reddit"), "channel", slug).alias("id"), "name",
        cascade(F.lower(F.concat_ws(" ", "name", "description")), V.SOCIAL_CATEGORY, "hackathons").alias("category"),
        F.concat(F.lit("r/"), F.col("channel"), F.lit(" Community")).alias("organizer"), "description", F.lit("Open to all (check post)").alias("eligibility"),
        F.coalesce(deadline_in_text("_full"), F.lit("Check community post")).alias("deadline"), F.lit("Online / Hybrid").alias("mode"), F.lit("open").alias("status"),
        F.col("_link").alias("application_link"), F.coalesce("permalink", "_link").alias("website"), F.concat(F.lit("reddit:r/"), F.col("channel")).alias("source"),
        F.array(F.lit("reddit"), F.lit("community"), "channel", "topic").alias("tags"), prize.alias("prize"), stipend.alias("stipend"),
        F.when(topic == "internships", "India / Remote / Global").alias("location"), F.when(topic == "open-source-programs", "10-12 weeks").alias("duration"),
        F.when(topic == "hackathons", "1-4").alias("team_size"))


def tweet_records(tweets: DataFrame, *keys: str) -> DataFrame:
    """Short posts (text, url, author, channel) of at least 20 characters, flagged for review."""
    check = F.lit("Check source for details")
    rows = tweets.where(F.length(text("text")) >= 20).withColumn("name", strip(F.col("text")))
    return rows.select(
        *keys, "name", F.col("text").alias("description"), cascade(F.lower(F.concat_ws(" ", "name", "text")), V.SOCIAL_CATEGORY, "hackathons").alias("category"),
        first_nonblank("author", F.concat(F.lit("Found via "), F.col("channel"))).alias("organizer"), *[check.alias(c) for c in ("eligibility", "mode", "fee", "deadline")],
        text("url").alias("application_link"), text("url").alias("website"), F.array(F.lit("twitter"), F.lit("auto-discovered")).alias("tags"),
        F.lit("open").alias("status"), F.concat(F.lit("twitter-"), F.col("channel")).alias("source"), F.lit(True).alias("needs_review"))
