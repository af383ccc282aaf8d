"""Constants of the query semantics (fixed values)."""

from __future__ import annotations

# Trends
OBSERVATION_DAYS = 7
BASELINE_DAYS = 30
LIFT_CAP = 999.0
EMERGING_LIFT = 1.5
EMERGING_MENTIONS = 3
SPIKE_FACTOR = 1.5
SPIKE_ARTICLES = 3
FREE_HISTORY_DAYS = 3

# Similarity and grouping
WORD_WEIGHT = 0.6
SAME_STORY = 0.15
ENTITY_FLOOR = 0.45
SIGNATURE_FLOOR = 0.04
SEMANTIC_FLOOR = 0.55
PLACE_WEIGHT = 0.5
STORY_WINDOW_HOURS = 72
ACTIVE_VELOCITY = 1.5

# Archive, briefs, tiers
PAGE_SIZE = 25
MOST_OFFSET = 2500
RETENTION_DAYS = 30
SEARCH_WORDS = 8
EXCERPT_UNITS = 220
BRIEF_CLUSTERS = 5
FREE_TOPICS = 3
TOKEN_DAYS = 30
ACTIVATION_HOURS = 24
MOST_BULLETS = 3
LEAST_SENTENCE_UNITS = 24

# Feedback
WEIGHTS = {"thumbs_up": 1, "thumbs_down": -1, "more_like_this": 2, "less_like_this": -2, "hide_source": 0}

# Histograms of velocity, and its threshold curve
VELOCITY_EDGES = (0.0, 0.5, 1.0, 1.5, 2.0, 3.0, 5.0)
VELOCITY_CURVE = (0.25, 0.5, 1.0, 1.5, 2.0, 3.0, 5.0)
