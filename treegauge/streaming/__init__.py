"""File events: what they are worth, whose they are, when to act."""
