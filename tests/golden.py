"""Own games of different shapes; their values come from brute force."""

from .helpers import brute_force, parse

GAMES = {
    "one": "7",
    "pair": "3 8",
    "any": "2 + 5 + 9 + 11",
    "fan": "4 6 + 4 7 + 4 10",
    "majority": "1 2 + 1 3 + 2 3",
    "ring": "1 2 + 2 3 + 3 4 + 4 5 + 1 5",
    "teams": "1 2 + 3 4 + 5 6",
    "ladder": "1 2 + 1 3 4 + 1 3 5 6",
    "spare": "9 + 1 2 3 + 1 4",
    "wide": "0 1 2 3 4 5 6 7",
    "bridge": "1 4 + 2 5 + 1 3 5 + 2 3 4",
    "three of four": "2 4 6 + 2 4 8 + 2 6 8 + 4 6 8",
    "lumpy": "10 11 12 + 10 13 + 11 14 15 + 12 13 14",
}

VALUES = {name: brute_force(parse(text)) for name, text in GAMES.items()}
