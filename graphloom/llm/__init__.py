"""Training-data operators; nothing else in graphloom imports this subpackage."""
