"""Fetchers for the paged source."""


def three_pages(query, first, last, cursor):
    page = cursor or 0
    return [{"title": f"{query} {first} {page}", "doi": f"10.1/{first}{page}"}], page + 1 if page < 2 else None


def broken(query, first, last, cursor):
    raise OSError("no network")


def needs_file(query, first, last, cursor):
    """Two pages a window, one row of which all windows share; February works only once the file of the query is there."""
    import os

    if first == "2024-02-01" and not os.path.exists(query):
        raise RuntimeError("broke off")
    page = cursor or 0
    return [{"doi": f"10.1/{first}/{page}", "title": query}, {"doi": "10.1/all", "title": "shared"}], 1 if page == 0 else None
