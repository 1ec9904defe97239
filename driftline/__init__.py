"""Change-intelligence analytics, expressed as DataFrame plans."""
