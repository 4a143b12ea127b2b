"""Word lists and tags whose content decides results."""

# Words too common in film reviews to say anything about one film.
FILM_STOPWORDS = [
    "movie", "movies", "film", "films", "cinema",
    "series", "season", "seasons", "episode", "episodes", "parasite",
    "watch", "watched", "watching", "rewatch", "rewatched",
    "see", "seeing", "saw", "seen",
    "view", "viewed", "viewer", "viewers",
    "director", "directors", "directed",
    "actor", "actors", "actress", "actresses",
    "cast", "crew", "screenplay",
    "scene", "scenes", "shot", "shots",
    "character", "characters",
    "story", "stories", "plot", "subplot",
    "ending", "endings", "opening",
    "really", "very", "quite", "lot", "lots",
    "imdb", "netflix", "hbo", "disney", "marvel",
    "dvd", "blu", "blu ray", "bluray",
    "spoiler", "spoilers",
    "thing", "things", "kind", "sort",
]

# Korean words left out of frequency lists.
KOREAN_STOPWORDS = ["영화", "보다", "있다", "없다", "너무", "같다"]

# Korean lemmas the normaliser always drops.
NORMALISER_STOPWORDS = ["하다", "되다", "이다"]

# Part-of-speech tags kept by the normaliser start with one of these.
KEPT_TAGS = ["NN", "VV", "VA", "VCP", "VCN", "MA"]

# Column names a review text may have, in order of preference.
TEXT_COLUMNS = ["comment", "content", "review", "text"]

# Header names of the two crawl layouts and the names used here.
ARTICLE_HEADERS = {"작성자": "author", "제목": "title", "별점": "rating", "내용": "text"}
CARD_HEADERS = {
    "작성자ID": "author",
    "별점": "rating",
    "내용": "text",
    "작성일자": "date",
    "공감수": "upvote",
    "비공감수": "downvote",
}
