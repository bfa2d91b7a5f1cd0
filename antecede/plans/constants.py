"""Fixed values of the game log the features were designed for.

They are configuration: no operator refers to them, only ``GAME`` in roles.py.
"""

# World of each title; the first group listing a title wins.
# The group '' has no world and so never matches a label.
WORLD_TITLES = {
    "TREETOPCITY1": (
        "Tree Top City - Level 1", "Ordering Spheres", "All Star Sorting", "Costume Box",
        "Fireworks (Activity)", "12 Monkeys", "Tree Top City - Level 2", "Flower Waterer (Activity)",
        "Pirate's Tale", "Mushroom Sorter (Assessment)",
    ),
    "TREETOPCITY2": (
        "Air Show", "Treasure Map", "Tree Top City - Level 3", "Crystals Rule", "Rulers",
        "Bug Measurer (Activity)", "Bird Measurer (Assessment)",
    ),
    "CRYSTALCAVES1": (
        "Crystal Caves - Level 1", "Chow Time", "Balancing Act", "Chicken Balancer (Activity)",
        "Lifting Heavy Things", "Crystal Caves - Level 2", "Honey Cake", "Happy Camel",
        "Cart Balancer (Assessment)",
    ),
    "CRYSTALCAVES2": (
        "Leaf Leader", "Crystal Caves - Level 3", "Heavy, Heavier, Heaviest", "Pan Balance",
        "Egg Dropper (Activity)", "Chest Sorter (Assessment)",
    ),
    "": ("Welcome to Lost Lagoon!",),
}
WORLD_DEFAULT = "MAGMAPEAK"

# World of each assessment in the label table.
LABEL_WORLDS = {
    "TREETOPCITY1": ("Mushroom Sorter (Assessment)",),
    "TREETOPCITY2": ("Bird Measurer (Assessment)",),
    "MAGMAPEAK": ("Cauldron Filler (Assessment)",),
    "CRYSTALCAVES1": ("Cart Balancer (Assessment)",),
}
LABEL_WORLD_DEFAULT = "CRYSTALCAVES2"

# Event codes.
START_CODE = 2000
SUBMIT_CODE = 4100
SUBMIT_CODE_BY_TITLE = {"Bird Measurer (Assessment)": 4110}

# Seconds that bound the scores 0, 1 and 2 of a clip.
CLIP_RULES = {
    "Ordering Spheres": (1, 24, 61),
    "Costume Box": (1, 17, 61),
    "12 Monkeys": (1, 14, 109),
    "Pirate's Tale": (1, 10, 80),
    "Treasure Map": (1, 10, 156),
    "Rulers": (1, 25, 126),
    "Slop Problem": (1, 7, 60),
    "Balancing Act": (1, 25, 72),
    "Lifting Heavy Things": (1, 20, 118),
    "Honey Cake": (1, 70, 142),
    "Heavy, Heavier, Heaviest": (1, 24, 61),
}

# Event ids.
CLIP_START = "27253bdc"
ASSESSMENT_STARTS = ("3bfd1a65", "f56e0afc", "7ad3efc6", "5b49460a", "90d848e0")
FIRST_CORRECT_GAME = {
    "1cc7cfca": "All Star Sorting",
    "cfbd47c8": "Chow Time",
    "3d8c61b0": "Happy Camel",
    "2a444e03": "Pan Balance",
    "792530f8": "Dino Drink",
}
FIRST_CORRECT_ACTIVITY = {
    "02a42007": "Fireworks",
    "5d042115": "Flower Waterer",
    "e79f3763": "Bug Measurer",
    "56bcd38d": "Chicken Balancer",
    "5e812b27": "Sandcastle Builder",
    "bb3e370b": "Bottle Filler",
}
HELP_GAME = {
    "05ad839b": "Happy Camel",
    "19967db1": "Chow Time",
    "6043a2b4": "All Star Sorting",
    "67aa2ada": "Leaf Leader",
    "6aeafed4": "Bubble Bath",
    "6f4bd64e": "Air Show",
    "6f8106d9": "Dino Drink",
    "92687c59": "Scrub_A_Dub",
    "93edfe2e": "Crystals Rule",
    "d3640339": "Dino Dive",
    "e080a381": "Pan Balancer",
}
HELP_ACTIVITY = {
    "08ff79ad": "Egg Dropper",
    "37937459": "Sandcastle Builder",
    "47efca07": "Bottle Filler",
    "47f43a44": "Flower Waterer",
    "85d1b0de": "Chicken Balancer",
    "8d748b58": "Bug Measurer",
    "e7e44842": "Watering Hole",
    "f54238ee": "Fireworks",
}
