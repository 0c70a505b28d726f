"""quaverlake: similarity and list-building analytics on Spark."""
