"""K9: one entry point for every search mode."""

from __future__ import annotations

from pyspark.sql import DataFrame

from lumicat.catalog import Catalog
from lumicat.functions.text import SEARCH_MODES
from lumicat.operators import sampling, search as text_search
from lumicat.operators.search import posts_with_media


def image_rows(cat: Catalog) -> DataFrame:
    return cat.images.select("id", "name", "width", "height")


def search(cat: Catalog, mode: str, q: str = "", seed: int = 0, limit: int = 50,
           offset: int = 0, media: bool = False) -> DataFrame:
    """The page of posts or images for a mode. An empty query shows the newest
    posts; ``random`` samples posts, or images for the query ``images``. With
    ``media`` the posts carry their media lists. Vector searches have their own
    functions."""
    mode = mode if mode in SEARCH_MODES else "tag"
    limit, offset = max(limit, 1), max(offset, 0)
    if not q:
        posts = text_search.newest_posts(cat, limit, offset)
    elif mode == "author":
        posts = text_search.posts_by_author(cat, q, limit, offset)
    elif mode == "title":
        posts = text_search.posts_by_title(cat, q, limit, offset)
    elif mode == "random" and q != "images":
        posts = sampling.random_rows(cat.posts, seed, limit, offset)
    elif mode == "random":
        return sampling.random_rows(image_rows(cat), seed, limit, offset)
    elif mode == "tag":
        return text_search.images_by_tag(cat, q, limit, offset)
    elif mode == "similar":
        raise ValueError("similar search takes image ids: use vectors.knn_by_ids")
    else:  # a description search needs its query vector: vectors.knn
        return image_rows(cat).limit(0)
    return posts_with_media(cat, posts) if media else posts

