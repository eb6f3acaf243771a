"""Research-portfolio analytics as lazy DataFrame plans."""
