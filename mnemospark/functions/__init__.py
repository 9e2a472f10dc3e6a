"""Column functions; everything here stays inside Catalyst unless it says otherwise."""
