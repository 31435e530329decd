"""Pages written by hand in layouts that no generator of the package makes, with the main text each should give."""

PAGES = [
    # an old table layout
    (
        """<HTML><HEAD><TITLE>Garden notes</TITLE></HEAD><BODY BGCOLOR=white><TABLE width=100%><TR><TD colspan=2 class=top><A HREF=/>Home</A> | <A HREF=/map>Map</A> | <A HREF=/mail>Mail us</A></TD></TR>
<TR><TD width=150 class=leftmenu><A HREF=a>Roses</A><BR><A HREF=b>Tulips</A><BR><A HREF=c>Ferns</A></TD><TD class=maintext><H1>Watering in a dry summer</H1><P>Water early in the morning, when the soil is cool and the leaves can dry before noon. Deep, rare watering is better than a little every day.
<P>Mulch keeps the ground moist for longer. A layer of straw, two fingers deep, halves the loss on a hot day.</TD></TR><TR><TD colspan=2 class=footer>&copy; 2003 The Garden Club. All rights reserved.</TD></TR></TABLE></BODY></HTML>""",
        "Watering in a dry summer\nWater early in the morning, when the soil is cool and the leaves can dry before noon. Deep, rare watering is better than a little every day.\nMulch keeps the ground moist for longer. A layer of straw, two fingers deep, halves the loss on a hot day.",
    ),
    # a blog of nested divs
    (
        """<!doctype html><html lang="en"><head><title>Sourdough</title><link rel=stylesheet href=x.css></head><body><div id="page"><div id="masthead"><a href="/" rel="home">Crumb</a><div class="site-description">Bread, mostly</div></div>
<div class="nav-menu"><ul><li><a href="/">Home</a></li><li><a href="/about">About</a></li></ul></div><div id="primary"><div class="post hentry"><h2 class="entry-title">My starter, one year on</h2>
<div class="entry-content"><p>It began as flour and water in a jar. For a week nothing happened, and then, overnight, it doubled.</p><p>I feed it <em>twice</em> a week now: fifty grams of rye, fifty of water. It forgives a lot.</p><h3>What went wrong</h3><ul><li>Too cold a kitchen, in January.</li><li>Chlorine in the tap water, for which I blame the pipes.</li></ul></div></div>
<div id="comments"><h3>2 thoughts</h3><ol class="commentlist"><li><p>Mine died twice before it lived, so take heart.</p></li><li><p>Which rye do you use? I cannot find a good one.</p></li></ol><div id="respond"><form><textarea name=c>Say something</textarea><button>Post</button></form></div></div></div>
<div id="secondary" class="widget-area"><div class="widget"><h4>Archives</h4><ul><li><a>May</a></li><li><a>June</a></li></ul></div></div><div id="colophon" class="site-footer">Proudly baked by hand</div></div></body></html>""",
        "My starter, one year on\nIt began as flour and water in a jar. For a week nothing happened, and then, overnight, it doubled.\nI feed it twice a week now: fifty grams of rye, fifty of water. It forgives a lot.\nWhat went wrong\nToo cold a kitchen, in January.\nChlorine in the tap water, for which I blame the pipes.",
    ),
    # a news page
    (
        """<html><head><meta charset=utf-8><title>Bridge</title></head><body class="home"><div role="banner"><a href=/>The Courier</a><div role="search"><form><input name=q><button>Go</button></form></div></div><div role="navigation"><a>World</a><a>City</a><a>Sport</a></div>
<main id="main"><article itemscope><header><h1>Old bridge to close for repairs</h1></header><p class="lead">The iron bridge over the river will close for nine months from April, the city said on Monday.</p><figure><img src=b.jpg alt="bridge"><figcaption>The bridge in 1911.</figcaption></figure><p>Engineers found rust in two of its four piers. "It is safe, but it will not stay safe," said the chief surveyor.</p>
<div class="newsletter-signup"><p>Get our morning mail</p><form><input><button>Sign up</button></form></div><p>Buses will use the southern bridge, which adds about ten minutes to most journeys.</p></article><div class="related-links"><h2>More from City</h2><ul><li><a>Tram plan delayed</a></li><li><a>Market to move</a></li></ul></div></main>
<div role="contentinfo"><p>About us &middot; Terms &middot; Privacy</p></div><script>track({"a":"</p>"})</script></body></html>""",
        'Old bridge to close for repairs\nThe iron bridge over the river will close for nine months from April, the city said on Monday.\nThe bridge in 1911.\nEngineers found rust in two of its four piers. "It is safe, but it will not stay safe," said the chief surveyor.\nBuses will use the southern bridge, which adds about ten minutes to most journeys.',
    ),
    # a page of documentation
    (
        """<!DOCTYPE html><html><body><div class="toolbar"><button>Theme</button><input type=search placeholder=Search></div><nav class="toc"><ol><li><a href=#a>Install</a></li><li><a href=#b>Use</a></li></ol></nav><section class="body" role="main"><h1>The frobnicator</h1><p>Install it with the package tool of your system, then run it once to write its settings.</p>
<pre>frob --init
frob --run</pre><h2 id=b>Use</h2><p>Each run reads the settings, opens the device and prints a line for every event &mdash; until you stop it.</p><table><tr><th>Flag</th><th>Meaning</th></tr><tr><td>--quiet</td><td>print nothing</td></tr></table><blockquote><p>Do not run two at once.</p></blockquote></section><footer><p>Built on Tuesday</p></footer></body></html>""",
        "The frobnicator\nInstall it with the package tool of your system, then run it once to write its settings.\nfrob --init frob --run\nUse\nEach run reads the settings, opens the device and prints a line for every event — until you stop it.\nFlag\nMeaning\n--quiet\nprint nothing\nDo not run two at once.",
    ),
    # hardly any marks, broken markup
    (
        """<body><center><a href=index.html>back</a> <a href=next.html>next</a></center><h1>Letter from the coast<p>Dear all, the boats came in late, and with little. <b title="5" tall">Nobody minds</b>; the weather was kind.<p>We walked to the light &amp; back, nine miles, and slept like stones.<hr><small>mail the webmaster</small>""",
        "Letter from the coast\nDear all, the boats came in late, and with little. Nobody minds; the weather was kind.\nWe walked to the light & back, nine miles, and slept like stones.",
    ),
    # a cookie wall, adverts between paragraphs, an author box and a second sidebar
    (
        """<html><body><div id="cookie-consent"><p>We and our partners store data on your device. Choose what you allow.</p><button>Accept</button></div><div class="wrap"><div class="sidebar left"><p>Weather: 12 degrees, light wind from the west.</p></div><div class="article-body"><h1>How owls hear</h1><p>An owl's ears sit at different heights, so a sound reaches one a little earlier than the other.</p>
<div class="ad-slot">Advertisement: shoes, half price</div><p>From that difference the bird works out how far above or below it a mouse is, in complete darkness.</p><div class="share-buttons"><a>Tweet</a><a>Pin</a></div><p>The face is a dish. It gathers sound as a cupped hand does.</p></div><div class="author-box"><p>Ann writes about birds and lives by a wood.</p></div><aside><h3>Popular</h3><p>Ten birds to see this spring</p></aside></div><footer>Imprint</footer></body></html>""",
        "How owls hear\nAn owl's ears sit at different heights, so a sound reaches one a little earlier than the other.\nFrom that difference the bird works out how far above or below it a mouse is, in complete darkness.\nThe face is a dish. It gathers sound as a cupped hand does.",
    ),
]
